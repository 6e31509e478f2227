"""Quality scores by a generalised additive model with pairwise interactions.

Each feature is cut into bins; a lookup table per feature, and one per chosen pair of features, is learned by
cyclic boosting: each turn fits a shallow tree to the residuals along one feature (or a quadrant tree along a pair)
and adds it to that table. A score is a sum of table entries, so scoring is a few vectorised lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import NOT_BLANK, Splitter, SpanHasher, slices, text_bytes
from gradeloom.llm.samples import by_hash
from gradeloom.sources.shared import materialize

#: Labelled rows that a fit takes at most, chosen by a hash of the key.
FIT_ROWS = 20_000


def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_CLASSES = {
    "upper": _bytes_of((65, 90)),
    "digits": _bytes_of((48, 57)),
    "symbols": _bytes_of((35, 38), (42, 43), (60, 62), (64, 64), (92, 92), (94, 96), (123, 126)),
    "stops": _bytes_of((44, 44), (46, 46), (58, 59)),
    "shouts": _bytes_of((33, 33), (63, 63)),
    "not_ascii": _bytes_of((128, 255)),
    "lines": _bytes_of((10, 10)),
}
FEATURES = [
    "log_words", "word_bytes", *_CLASSES, "distinct_words", "repeated_lines", "top_word", "long_words", "short_words",
]


class TextFeatures:
    """Features of each text of a block, from all its bytes; an empty text has zeros throughout."""

    def __init__(self) -> None:
        self.split, self.hasher = Splitter(NOT_BLANK), SpanHasher()

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        words, n = self.split(column), len(column)
        counts = np.diff(words.first).astype(float)
        some = np.maximum(counts, 1)
        sizes = words.end - words.start
        inside = np.maximum(_sums(sizes, words.first), 1)
        parts = {"log_words": np.log1p(counts), "word_bytes": _sums(sizes, words.first) / some}
        for name, wanted in _CLASSES.items():
            per = some if name == "lines" else inside
            parts[name] = _sums(wanted[data], offsets) / per
        distinct, most = _distinct(words.hash, words.first)
        parts["distinct_words"], parts["top_word"] = distinct / some, most / some
        parts["long_words"] = _sums(sizes > 14, words.first) / some
        parts["short_words"] = _sums(sizes < 3, words.first) / some
        ends = np.flatnonzero(data == 10)
        cut = np.unique(np.concatenate([ends + 1, offsets]))
        start, end = cut[:-1], cut[1:]
        end = end - (data[end - 1] == 10) if len(data) else end
        filled = end > start
        start, end = start[filled], end[filled]
        first = np.searchsorted(start, offsets)
        lines = self.hasher(data, start, end) if len(start) else np.zeros(0, np.uint64)
        different, _ = _distinct(lines, first)
        parts["repeated_lines"] = 1 - different / np.maximum(np.diff(first), 1)
        parts["repeated_lines"][np.diff(first) == 0] = 0
        return np.stack([parts[f] for f in FEATURES], axis=1).reshape(n, len(FEATURES))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets]).astype(float)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each run, and the count of the most frequent one."""
    runs = len(first) - 1
    owner = np.repeat(np.arange(runs), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool))
    size = np.diff(np.append(new, len(h)))
    most = np.zeros(runs, np.int64)
    np.maximum.at(most, o[new], size)
    return np.bincount(o[new], minlength=runs).astype(float), most.astype(float)


@dataclass
class AdditiveModel:
    """Lookup tables of features and pairs. ``edges`` are the bin borders of each feature."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: at most 2 ** depth pieces, each cut where the gain is largest."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gains)) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:cut] = _shallow_tree(g[:cut], h[:cut], depth - 1)
            out[cut:] = _shallow_tree(g[cut:], h[cut:], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps of the best tree with one cut along each of two features, and its gain."""
    sums = [np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h)]
    corners = []
    for s in sums:
        low, high, all_ = s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        both = s[1:-1, 1:-1]
        corners.append((both, low - both, high - both, all_ - low - high + both))
    gains = sum(_gain(a, b) for a, b in zip(*corners))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = np.empty_like(g)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = (
        a[i, j] / (b[i, j] + 1.0) for a, b in zip(*corners)
    )
    return step, float(gains[i, j] - _gain(g.sum(), h.sum()))


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, turns: int = 150, depth: int = 2, rate: float = 0.1, pairs: int = 6,
    pair_turns: int = 60,
) -> AdditiveModel:
    """Boost tables of single features in turn, then tables of the ``pairs`` pairs with the largest gain left."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(cuts, float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(c) + 1) for c in cuts]
    b = model.bins(x)
    raw = model.raw(b)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(turns):
        for k, t in enumerate(model.tables):
            g, h = (np.bincount(b[:, k], r, len(t)) for r in residuals())
            step = rate * _shallow_tree(g, h, depth)
            t += step
            raw += step[b[:, k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        return tuple(np.bincount(b[:, i] * shape[1] + b[:, j], r, shape[0] * shape[1]).reshape(shape) for r in residuals())

    usable = [k for k, t in enumerate(model.tables) if len(t) > 1]
    ranked = sorted(combinations(usable, 2), key=lambda p: -_quadrants(*grid(*p))[1])[:pairs]
    model.pairs = {p: np.zeros((len(model.tables[p[0]]), len(model.tables[p[1]]))) for p in ranked}
    for _ in range(pair_turns):
        for (i, j), t in model.pairs.items():
            step = rate * _quadrants(*grid(i, j))[0]
            t += step
            raw += step[b[:, i], b[:, j]]
    return model


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``features array<double>`` (in the order of ``FEATURES``) of each row; null texts count as empty."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = TextFeatures()
        for batch in slices(batches, "text"):
            x = features(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "features"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, features array<double>")


def fit_quality(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> AdditiveModel:
    """Fit on rows of ``features`` whose key has a label 0 or 1, ``FIT_ROWS`` of them at most, chosen by hash.

    Null keys and labels are left out. Without rows of both labels the model scores all rows alike.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)")
    both = features.join(marked, "key").withColumn("h", F.xxhash64("key"))
    rows = by_hash(both, "h", FIT_ROWS).select("features", "y").collect()
    x = np.array([r.features for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in rows], float)
    if len(set(y.tolist())) < 2:
        return AdditiveModel([np.zeros(0)] * len(FEATURES), 0.0 if not len(y) else (9.0 if y[0] else -9.0))
    return fit(x, y)


def score_features(features: DataFrame, model: AdditiveModel, key: str = "key") -> DataFrame:
    """``key`` and ``score double`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.score(x))], names=[key, "score"])

    return features.select(key, "features").mapInArrow(run, f"{key} {features.schema[key].dataType.simpleString()}, score double")


def with_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", score: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` and ``score double``; a column of that name is replaced. Nothing is shuffled."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == score.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = TextFeatures()
        for batch in slices(batches, text):
            scores = pa.array(model.score(features(batch.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, docs.select("*").schema.add(score, "double"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    keep_out: str = "pmod(crc32(cast(key AS string)), 4) = 2",
) -> DataFrame:
    """Quality of each row of ``docs``: ``doc_key, held_out boolean, score double`` (0 to 1).

    Labels of rows for which ``keep_out`` holds are never used. Only the text is scored; empty and null texts are
    scored like texts without words. Repeated rows and null keys give a row each; an empty ``docs`` gives no rows and
    without usable labels every score is the same. Other columns are not read, whatever their names.

    The texts are read once; features are stored. The driver fits on ``FIT_ROWS`` rows of features.
    """
    features = materialize(text_features(docs, key, text), "features")
    held = f"coalesce({keep_out}, false)"
    model = fit_quality(features.where(f"NOT {held}"), labels, key, label)
    return score_features(features, model).selectExpr("key AS doc_key", f"{held} AS held_out", "score")

"""Gradient boosting of several classes on the softmax loss, over histograms.

Features are cut into bins once; bins and running scores are kept as blocks of rows, a few arrays each. A round grows one tree per class, all of them level by level side by side: one job per
level adds up gradients by class, node, feature and bin, and finds the best split of every node where its cells meet.
Nothing but those cells is shuffled, and the driver gets one row per open node.

Gradients are rounded to multiples of 2**-24 and added as integers, so the trees do not depend on how rows are spread.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters as T
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasSeed,
    HasStepSize,
    HasValidationIndicatorCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.text import name
from gradeloom.operators.learners import ArraysModel, feature_array, list_column, matrix, width_of
from gradeloom.sources.shared import bounded_batches, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Gradients are counted in units of 1 / UNIT.
UNIT = float(1 << 24)
#: Rounds after which the running scores are written out; until then they are kept by the executors.
STORE_EVERY = 10
#: Rows of a block, and of a task at most.
BLOCK_ROWS = 1 << 16
TASK_ROWS = 1 << 20
#: Cells that a task adds up before it hands them on.
TASK_CELLS = 1 << 21
#: Cells of nodes whose splits one task looks for.
BEST_CELLS = 1 << 16


# ---------------------------------------------------------------- bins


def cut_points(df: DataFrame, column: str, width: int, max_bins: int) -> list[np.ndarray]:
    """Sorted cuts of each feature: between all neighbouring values if there are at most ``max_bins`` of them, else at
    quantiles. Missing values (null, NaN) have a bin of their own and count for nothing here."""
    values = df.select(feature_array(df, column).alias("v"))
    each = [f"nullif(v[{k}], double('NaN'))" for k in range(width)]
    about = values.selectExpr(*[f"approx_count_distinct({e}) AS c{k}" for k, e in enumerate(each)]).first()
    few = [k for k in range(width) if about[k] <= 2 * max_bins]
    cuts: dict[int, np.ndarray] = {}
    if few:
        pairs = ", ".join(f"struct({k} AS k, {each[k]} AS x)" for k in few)
        found = values.select(F.explode(F.expr(f"array({pairs})")).alias("p")).where("p.x IS NOT NULL").select("p.*")
        own: dict[int, list[float]] = {k: [] for k in few}
        for r in found.distinct().collect():  # at most about 2 * max_bins values of a feature
            own[r.k].append(r.x)
        for k, xs in own.items():
            xs = np.sort(np.array(xs, float))
            if len(xs) <= max_bins:
                cuts[k] = xs[:-1] + (xs[1:] - xs[:-1]) / 2
    many = [k for k in range(width) if k not in cuts]
    if many:
        shares = ", ".join(repr(j / max_bins) + "D" for j in range(1, max_bins))
        row = values.selectExpr(*[f"percentile_approx({each[k]}, array({shares}), 10000) AS q{k}" for k in many]).first()
        for k, q in zip(many, row):
            cuts[k] = np.unique(np.array(q, float))
    return [cuts[k] for k in range(width)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for missing values, else one more than the number of cuts below the value."""
    out = np.zeros(x.shape, np.int16)
    for k, c in enumerate(cuts):
        there = ~np.isnan(x[:, k])
        out[there, k] = 1 + np.searchsorted(c, x[there, k], "left")
    return out


# ---------------------------------------------------------------- trees


def empty_trees(n_classes: int, depth: int) -> dict[str, np.ndarray]:
    """Trees of one round as arrays over class and node: node k has the children 2k + 1 and 2k + 2."""
    shape = n_classes, (2 << depth) - 1
    return {
        "feature": np.full(shape, -1, np.int16),
        "cut": np.zeros(shape, np.int16),
        "missing_left": np.zeros(shape, bool),
        "value": np.zeros(shape, np.float64),
    }


def nodes_of(bins: np.ndarray, trees: dict[str, np.ndarray], c: int, levels: int) -> np.ndarray:
    """Node of the tree of class ``c`` that each row has reached after ``levels`` levels."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    feature, cut, missing_left = trees["feature"][c], trees["cut"][c], trees["missing_left"][c]
    for _ in range(levels):
        f = feature[node]
        b = bins[rows, np.maximum(f, 0)]
        left = np.where(b == 0, missing_left[node], b <= cut[node])
        node = np.where(f >= 0, 2 * node + 2 - left, node)
    return node


def added_margins(bins: np.ndarray, margins: np.ndarray, rounds: list[dict[str, np.ndarray]], depth: int) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for c in range(margins.shape[1]):
            margins[:, c] += trees["value"][c][nodes_of(bins, trees, c, depth)]
    return margins


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(h: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Rows of a round's sample, by a hash of the row: the same wherever the row is."""
    if share >= 1:
        return np.ones(len(h), bool)
    x = h.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (round_ + 1) * 0xD6E8FEB86659FD93) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < share


class SoftmaxLoss:
    """What the trees of a round fit: slopes and curvatures of the softmax loss. Followed is the loss itself."""

    unit = UNIT

    def begun(self, margins: np.ndarray, y: np.ndarray, round_: int) -> np.ndarray:
        return softmax_rows(margins)

    def followed(self, margins: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))

    def slopes(self, p: np.ndarray, y: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Slope and curvature of each row for class ``c``; None stands for a curvature of 1, so that sums are counts."""
        return p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])


def best_split(cells: np.ndarray, penalty: float, least: float, features: np.ndarray, unit: float = UNIT) -> tuple:
    """Split of a node with the largest gain, from ``cells`` (features, bins, [gradient, curvature]).

    Values of bins up to ``cut`` go left; a cut behind the last bin parts missing values from all others.
    Returns ``(gain, feature, cut, missing_left, G, H, GL, HL)``; gain 0 means none. Equal gains go to the first feature,
    then the lowest cut, then to missing values on the right. If a node has no missing values, they will follow
    the heavier side.
    """
    total = cells[features[0]].sum(axis=0)
    g, h = total[0] / unit, total[1] / unit
    whole = g * g / (h + penalty) if h + penalty > 0 else 0.0
    best = (0.0, -1, 0, False, g, h, 0.0, 0.0)
    for f in features.tolist():
        below = np.cumsum(cells[f, 1:], axis=0)[:-1]
        missing = cells[f, 0]
        sides = np.stack([below, below + missing], axis=1) / unit  # by cut, missing right and left
        gl, hl = sides[:, :, 0], sides[:, :, 1]
        gr, hr = g - gl, h - hl
        ok = (hl >= least) & (hr >= least) & (hl > 0) & (hr > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - whole, -np.inf)
        if not gain.size:
            continue
        at = int(gain.argmax())
        cut, side = divmod(at, 2)
        if gain[cut, side] > best[0] + 1e-9:
            left = bool(side) if missing.any() else bool(hl[cut, 0] >= hr[cut, 0])
            best = (float(gain[cut, side]), f, cut + 1, left, g, h, float(gl[cut, side]), float(hl[cut, side]))
    return best


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, HasSeed, HasValidationIndicatorCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", T.toInt)
    leafPenalty = Param(Params._dummy(), "leafPenalty", "L2 penalty of a leaf's value", T.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least curvature on each side of a split", T.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows of a round", T.toFloat)
    featureShare = Param(Params._dummy(), "featureShare", "share of features of a tree", T.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature at most", T.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes 0 to numClasses - 1", T.toInt)
    rowCol = Param(Params._dummy(), "rowCol", "column that tells rows apart for sampling; empty: the features", T.toString)
    patience = Param(Params._dummy(), "patience", "rounds without a lower validation loss before the end; 0: never", T.toInt)


class SoftmaxBoostedTrees(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for classes ``0 .. numClasses - 1``, with second-order steps on the softmax loss.

    The curvature of a class is ``2 p (1 - p)``: twice the diagonal bounds the whole Hessian, since each of its rows sums
    to that in absolute value. A leaf has the value ``-stepSize * G / (H + leafPenalty)``.

    Missing feature values (null, NaN) go to the side where they help more. Rows with a null label, or a
    label outside the classes, are an error. With ``validationIndicatorCol``, rows marked true do not grow trees; their loss is
    followed, and after ``patience`` rounds without a lower one the best round is the last.
    """

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability",
        maxIter=100, maxDepth=6, stepSize=0.1, leafPenalty=1.0, minWeight=1.0, subsamplingRate=1.0, featureShare=1.0,
        maxBins=64, numClasses=2, rowCol="", seed=42, validationIndicatorCol=None, patience=0,
    ) -> None:
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        defaults = dict(
            featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability", maxIter=100,
            maxDepth=6, stepSize=0.1, leafPenalty=1.0, minWeight=1.0, subsamplingRate=1.0, featureShare=1.0, maxBins=64,
            numClasses=2, rowCol="", seed=42, patience=0,
        )
        self._setDefault(**defaults)
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostedModel:
        p = {param.name: self.getOrDefault(param) for param in self.params if self.isDefined(param)}
        n, depth = p["numClasses"], p["maxDepth"]
        if not 2 <= p["maxBins"] <= 1000 or depth < 1 or n < 2:
            raise ValueError("maxBins must be 2 to 1000, maxDepth at least 1, numClasses at least 2")
        features, label = p["featuresCol"], F.col(name(p["labelCol"]))
        held = F.col(name(p["validationIndicatorCol"])) if "validationIndicatorCol" in p else F.lit(False)
        same = F.col(name(p["rowCol"])) if p["rowCol"] else F.array_join(feature_array(dataset, features).cast("array<string>"), ",")
        given = dataset.select(
            F.xxhash64(same).alias("h"),
            label.cast("int").alias("y"),
            F.coalesce(held.cast("boolean"), F.lit(False)).alias("held"),
            feature_array(dataset, features).alias("features"),
        )
        fault = given.where(f"y IS NULL OR y < 0 OR y >= {n}").limit(1).collect()
        if fault:
            raise ValueError(f"label {fault[0].y} is not one of {n} classes")
        width = width_of(given, "features")
        cuts = cut_points(given.where("NOT held"), "features", width, p["maxBins"])
        done, history = grown(given, cuts, p, SoftmaxLoss(), _of_a_tree(p, width), _Patience(p["patience"]))
        return self._copyValues(SoftmaxBoostedModel(tree_arrays(done, cuts, history, n, depth)))


class _Patience:
    """The number of rounds to keep once the watched loss has not fallen for ``rounds`` rounds, else None."""

    def __init__(self, rounds: int) -> None:
        self.rounds, self.least, self.best = rounds, np.inf, 0

    def __call__(self, r: int, losses: tuple[float, float]) -> int | None:
        if losses[1] < self.least:
            self.least, self.best = losses[1], r
        elif self.rounds and not np.isnan(losses[1]) and r - self.best >= self.rounds:
            return self.best
        return None


def _of_a_tree(p: dict, width: int):
    """Features that a node may use: a share drawn for each tree."""

    def drawn(r: int):
        random = np.random.default_rng((p["seed"], r))
        chosen = [np.sort(random.permutation(width)[: max(1, round(p["featureShare"] * width))]) for _ in range(p["numClasses"])]
        return lambda c, node: chosen[c]

    return drawn


def tree_arrays(done: list[dict[str, np.ndarray]], cuts: list[np.ndarray], history: list, n: int, depth: int) -> dict[str, np.ndarray]:
    """Arrays of a fitted model."""
    arrays = {k: np.stack([t[k] for t in done]) if done else np.zeros((0, *v.shape), v.dtype) for k, v in empty_trees(n, depth).items()}
    arrays["cuts"] = np.concatenate([*cuts, np.zeros(0)])
    arrays["n_cuts"] = np.array([len(c) for c in cuts], np.int64)
    arrays["history"] = np.array(history, np.float64).reshape(-1, 2)
    return arrays


def grown(given: DataFrame, cuts: list[np.ndarray], p: dict, loss, drawn, stop=None, last: bool = False) -> tuple[list[dict[str, np.ndarray]], list[tuple[float, float]]]:
    """Trees of ``p["maxIter"]`` rounds on rows ``(h, y, held, features)``, and the means followed before each round.

    ``loss`` says what the trees fit, ``drawn`` gives for a round the features that a node may use, and ``stop`` may end the rounds.
    A step is ``p["stepSize"]``, or the entry of ``p["steps"]``. With ``last``, the means after the last round follow.
    """
    with bounded_batches(given.sparkSession):
        return _grown(given, cuts, p, loss, drawn, stop, last)


def _grown(given: DataFrame, cuts: list[np.ndarray], p: dict, loss, drawn, stop, last: bool) -> tuple[list[dict[str, np.ndarray]], list[tuple[float, float]]]:
    n, depth, width = p["numClasses"], p["maxDepth"], len(cuts)
    cores = given.sparkSession.sparkContext.defaultParallelism
    spread = max(cores, math.ceil(given.count() / TASK_ROWS))
    blocks = given.repartition(spread).mapInArrow(_to_bins(cuts, n), BLOCK)
    state = materialize(blocks, "boosting").persist(StorageLevel.MEMORY_AND_DISK)
    done: list[dict[str, np.ndarray]] = []
    history: list[tuple[float, float]] = []
    before, n_bins = None, max(map(len, cuts)) + 3
    try:
        for r in range(p["maxIter"]):
            step = p["steps"][r] if "steps" in p else p["stepSize"]
            trees, means = _round(state, r, width, n_bins, p | {"stepSize": step}, loss, drawn(r))
            if before is not None:
                before.unpersist()
            history.append(means)
            kept = stop(r, means) if stop else None
            if kept is not None:
                return done[:kept], history
            done.append(trees)
            if r + 1 < p["maxIter"] or last:
                # The next job keeps the moved scores; a lost executor's are made again from the last table written.
                before, state = state, state.mapInArrow(_moved(trees, width, depth), BLOCK)
                if len(done) % STORE_EVERY == 0 and r + 1 < p["maxIter"]:
                    state = materialize(state, "boosting")
                state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if last:
            history.append(_round(state, p["maxIter"], width, n_bins, p | {"maxDepth": 1, "numClasses": 0}, loss, None)[1])
    finally:
        for kept_state in (before, state):
            if kept_state is not None:
                kept_state.unpersist()
    return done, history


def _round(state: DataFrame, r: int, width: int, n_bins: int, p: dict, loss, features) -> tuple[dict[str, np.ndarray], tuple[float, float]]:
    """The trees of a round, and the means of what is followed before it."""
    n, depth = p["numClasses"], p["maxDepth"]
    trees = empty_trees(n, depth)
    open_nodes, losses = [(c, 0) for c in range(n)], (np.nan, np.nan)
    for level in range(depth):
        cells = state.mapInArrow(
            _cells(trees, level, open_nodes, r, width, n_bins, p["seed"], p["subsamplingRate"], loss),
            "class int, node int, cell binary, sums binary",
        )
        lots = max(1, min(len(open_nodes) + 1, math.ceil(len(open_nodes) * width * n_bins / BEST_CELLS)))
        found = cells.repartition(lots, "class", "node").mapInArrow(
            _best(width, n_bins, p["leafPenalty"], p["minWeight"], features, loss.unit), "class int, node int, found array<double>"
        )
        open_nodes = []
        for row in found.collect():
            c, node = row["class"], row.node
            if c < 0:
                losses = tuple(row.found)
                continue
            gain, f, cut, left, g, h, gl, hl = row.found
            if level == 0:
                trees["value"][c, 0] = _leaf(g, h, p)
            if f >= 0:
                trees["feature"][c, node], trees["cut"][c, node], trees["missing_left"][c, node] = int(f), int(cut), bool(left)
                trees["value"][c, 2 * node + 1] = _leaf(gl, hl, p)
                trees["value"][c, 2 * node + 2] = _leaf(g - gl, h - hl, p)
                open_nodes += [(c, 2 * node + 1), (c, 2 * node + 2)]
        open_nodes.sort()
        if not open_nodes:
            break
    return trees, losses


def _leaf(g: float, h: float, p: dict) -> float:
    return -p["stepSize"] * g / (h + p["leafPenalty"]) if h + p["leafPenalty"] > 0 else 0.0


#: A block: hashes, classes and marks of rows; bins by feature and row; margins by row and class.
BLOCK = "h binary, y binary, held binary, bins binary, margins binary"


def _block(*arrays: np.ndarray) -> pa.RecordBatch:
    names = ["h", "y", "held", "bins", "margins"]
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays], names=names)


def _to_bins(cuts: list[np.ndarray], n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            h, y, marks, bins = (np.concatenate(x) for x in zip(*held))
            return _block(h, y, marks, bins.T, np.zeros((len(y), n_classes)))

        for batch in batches:
            if batch.num_rows:
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "y", "held")]
                held.append((*own, binned(matrix(batch.column("features"), len(cuts)), cuts)))
            if sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hashes, classes, marks, bins (feature, row) and margins of each block."""
    kinds = {"h": np.int64, "y": np.int32, "held": np.bool_, "bins": np.int16, "margins": np.float64}
    for batch in batches:
        for values in zip(*(batch.column(c) for c in kinds)):
            h, y, held, bins, margins = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(values, kinds.values()))
            yield h, y, held, bins.reshape(width, -1), margins.reshape(len(y), -1)


def _moved(trees: dict[str, np.ndarray], width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, y, held, bins, margins in _blocks(batches, width):
            yield _block(h, y, held, bins, added_margins(bins.T, margins, [trees], depth))

    return run


def _cells(trees: dict[str, np.ndarray], level: int, open_nodes: list[tuple[int, int]], round_: int, width: int, n_bins: int, seed: int, share: float, loss):
    """Sums of a task by class, node and cell (feature and bin); class -1 holds what is followed, of training rows in cell 0.

    Rows without a class (-1) are not followed."""
    by_class: dict[int, np.ndarray] = {}
    for c in {c for c, _ in open_nodes}:
        by_class[c] = np.full(trees["feature"].shape[1], -1, np.int64)
        own = [node for k, node in open_nodes if k == c]
        by_class[c][own] = np.arange(len(own))

    def emitted(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for c, cells in sums.items():
            nodes = np.flatnonzero(by_class[c] >= 0) if c >= 0 else np.zeros(1, np.int64)
            there = [np.flatnonzero(own.any(axis=1)) for own in cells]
            columns = [
                pa.array([c] * len(nodes), pa.int32()),
                pa.array(nodes.astype(np.int32)),
                pa.array([k.astype(np.int32).tobytes() for k in there], pa.binary()),
                pa.array([own[k].tobytes() for own, k in zip(cells, there)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "node", "cell", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for h, y, held, bins, margins in _blocks(batches, width):
            p = loss.begun(margins, y, round_)
            if level == 0:
                own = sums.setdefault(-1, np.zeros((1, 2, 2), np.int64))
                amount = np.rint(loss.followed(margins, p, y) * loss.unit)
                for k, rows in enumerate((~held & (y >= 0), held & (y >= 0))):
                    own[0, k] += (int(amount[rows].sum()), int(rows.sum()))
            grown = np.flatnonzero(~held & sampled(h, round_, seed, share))
            bins, y, p = bins[:, grown].astype(np.int64), y[grown], p[grown]
            for c, places in by_class.items():
                place = places[nodes_of(bins.T, trees, c, level)]
                g, h_ = (x if x is None else np.rint(x * loss.unit) for x in loss.slopes(p, y, c))
                own_bins = bins
                if level:
                    inside = np.flatnonzero(place >= 0)
                    if len(inside) < len(place):
                        place, g, h_, own_bins = place[inside], g[inside], h_ if h_ is None else h_[inside], bins[:, inside]
                count = int(places.max()) + 1
                own = sums.setdefault(c, np.zeros((count, width * n_bins, 2), np.int64))
                place = place * n_bins
                for f in range(width):
                    key = place + own_bins[f]
                    for k, w in enumerate((g, h_)):
                        # Integers below 2**53 add up exactly as doubles.
                        total = np.bincount(key, minlength=count * n_bins) * loss.unit if w is None else np.bincount(key, w, count * n_bins)
                        total = total.reshape(count, n_bins)
                        own[:, f * n_bins : (f + 1) * n_bins, k] += total.astype(np.int64)
                if sum(x.size for x in sums.values()) > TASK_CELLS:
                    yield from emitted(sums)
                    sums = {}
        yield from emitted(sums)

    return run


def _best(width: int, n_bins: int, penalty: float, least: float, features, unit: float):
    """Cells of a node from all tasks, added up, and its best split; the means of what is followed for class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, node, cell, own in zip(batch.column("class").to_pylist(), batch.column("node").to_pylist(), batch.column("cell"), batch.column("sums")):
                cells = sums.setdefault((c, node), np.zeros((2 if c < 0 else width * n_bins, 2), np.int64))
                cells[np.frombuffer(cell.as_buffer(), np.int32)] += np.frombuffer(own.as_buffer(), np.int64).reshape(-1, 2)
        found = []
        for (c, node), cells in sums.items():
            if c < 0:
                found.append([s / unit / n if n else float("nan") for s, n in cells])
            else:
                found.append([float(x) for x in best_split(cells.reshape(width, n_bins, 2), penalty, least, features(c, node), unit)])
        columns = [pa.array([k[i] for k in sums], pa.int32()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], names=["class", "node", "found"])

    return run


class SoftmaxBoostedModel(ArraysModel):
    """Fitted trees; ``history`` has the mean losses of training and validation rows before each round."""

    @property
    def numClasses(self) -> int:
        return self.arrays["feature"].shape[1]

    @property
    def numFeatures(self) -> int:
        return len(self.arrays["n_cuts"])

    @property
    def history(self) -> list[tuple[float, float]]:
        return [tuple(x) for x in self.arrays["history"].tolist()]

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        arrays, n = self.arrays, self.numClasses
        cuts = np.split(arrays["cuts"], np.cumsum(arrays["n_cuts"])[:-1])
        rounds = [{k: arrays[k][r] for k in ("feature", "cut", "missing_left", "value")} for r in range(len(arrays["feature"]))]
        depth = (arrays["feature"].shape[2] + 1).bit_length() - 2

        def score(x: np.ndarray) -> np.ndarray:
            return softmax_rows(added_margins(binned(x, cuts), np.zeros((len(x), n)), rounds, depth))

        return score

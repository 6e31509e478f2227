"""Isotonic calibration whose fit never passes through the driver or one task.

Scores are pooled per class and value, placed by range, and neighbouring violators are pooled inside each range. The
blocks that remain are dealt to lots with other borders until no border is violated: the order of pooling
does not matter, so this is the isotonic fit. Falling scores shrink by the size of a lot a round, rising ones are done in
the first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.functions.probability import argmax, normalised
from gradeloom.functions.text import array, name
from gradeloom.operators.learners import list_column, matrix
from gradeloom.operators.ranking import hash_rank
from gradeloom.sources.shared import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Blocks that a task pools, about.
BLOCKS_PER_TASK = 200_000
#: Up to so many blocks of all classes, the fit is sent to the tasks; beyond, it is joined by score ranges.
SENT_BLOCKS = 65_536
#: Blocks of a range of scores in that join.
RANGE_BLOCKS = 256


def pooled(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent violators: blocks in order of score, whose means do not fall."""
    out: list[list] = []
    for block in zip(lo.tolist(), hi.tolist(), n.tolist(), hits.tolist()):
        block = list(block)
        # Integers, so equal means are told exactly.
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            a = out.pop()
            block = [a[0], block[1], a[2] + block[2], a[3] + block[3]]
        out.append(block)
    columns = list(zip(*out)) if out else [[], [], [], []]
    return tuple(np.array(c, t) for c, t in zip(columns, (float, float, np.int64, np.int64)))


_COLUMNS = ["lo", "hi", "n", "hits"]
_BLOCKS = "k int, part long, place long, lo double, hi double, n long, hits long"


def _blocks(k: int, part: int, place: int, parts: list[tuple]) -> pa.RecordBatch:
    """Pooled blocks of a class, numbered from ``place`` on."""
    blocks = pooled(*(np.concatenate(c) for c in zip(*parts)))
    size = len(blocks[0])
    columns = [pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, part, np.int64)), pa.array(place + np.arange(size))]
    return pa.RecordBatch.from_arrays([*columns, *map(pa.array, blocks)], names=["k", "part", "place", *_COLUMNS])


def _pool_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool the violators of a sorted range, class by class; a class is handed on when it ends."""
    part, place = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    last = None
    for batch in batches:
        ks = batch.column("k").to_numpy()
        for k in np.unique(ks).tolist():
            if held and k != last:
                out = _blocks(last, part, place, held)
                place += out.num_rows
                yield out
                held = []
            own = np.flatnonzero(ks == k)
            # Pooled at once, so the task holds blocks, not scores.
            held = [pooled(*(np.concatenate(c) for c in zip(*held, tuple(batch.column(c).to_numpy()[own] for c in _COLUMNS))))]
            last = k
    if held:
        yield _blocks(last, part, place, held)


def _pool_lot(lot: pa.Table) -> pa.Table:
    """Pool the violators of neighbouring blocks."""
    lot = lot.sort_by("index")
    ks, part = lot.column("k").to_numpy(), lot.column("lot")[0].as_py()
    out, place = [], 0
    for k in np.unique(ks).tolist():
        own = np.flatnonzero(ks == k)
        out.append(_blocks(k, part, place, [tuple(lot.column(c).to_numpy()[own] for c in _COLUMNS)]))
        place += out[-1].num_rows
    return pa.Table.from_batches(out)


def isotonic_blocks(scores: DataFrame) -> DataFrame:
    """Stored blocks ``k, part, place, lo, hi, n, hits`` of the isotonic fit, from ``k, lo, hi, n, hits`` with rising scores
    per class ``k``. The driver sees counts only.

    After the first round blocks are dealt to lots by their number in order; the borders of the lots move by half a lot
    each round, so a violated border lies inside a lot in the next one.
    """
    scores = materialize(scores, "scores")
    ranges = max(1, -(-scores.count() // BLOCKS_PER_TASK))
    placed = scores.repartitionByRange(ranges, "k", "lo").sortWithinPartitions("k", "lo")
    blocks = materialize(placed.select("k", *_COLUMNS).mapInArrow(_pool_range, _BLOCKS), "blocks")
    shift = 0
    while True:
        mean = F.col("hits") / F.col("n")
        ends = blocks.groupBy("k", "part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        following = F.lead("first").over(Window.partitionBy("k").orderBy("part"))
        if not ends.withColumn("following", following).where("following <= last").count():
            return blocks
        # Blocks of the parts before each part; one row per part.
        before = blocks.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("size"))
        earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        before = materialize(before.select("p", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")), "before")
        numbered = blocks.join(before, F.col("part") == F.col("p")).withColumn("index", F.col("before") + F.col("place"))
        lots = numbered.selectExpr("k", *_COLUMNS, "index", f"(index + {shift}) DIV {BLOCKS_PER_TASK} AS lot")
        blocks = materialize(lots.groupBy("lot").applyInArrow(_pool_lot, _BLOCKS), "blocks")
        shift = BLOCKS_PER_TASK // 2 - shift


@dataclass(frozen=True)
class IsotonicCalibration:
    """Isotonic fit of each class against the rest, then rows are normalised to sum 1.

    Equal scores are pooled before the fit. Between two blocks the value is interpolated; below the first and above
    the last it is theirs. Rows without a class or score are left out of the fit; a null array stays null. Use rows
    the base model has not been fitted on.
    """

    n_classes: int
    probs: str = "probs"
    target: str = "y"

    def fit(self, df: DataFrame) -> IsotonicModel:
        rows = df.select(F.col(name(self.target)).alias("y"), F.posexplode(F.col(name(self.probs))).alias("k", "score"))
        rows = rows.where(f"y IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND k < {self.n_classes}")
        # -0.0 and 0.0 are one score.
        scores = rows.withColumn("score", F.col("score").cast("double") + F.lit(0.0)).groupBy("k", "score")
        scores = scores.agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("k")).alias("hits"))
        blocks = isotonic_blocks(scores.selectExpr("int(k) AS k", "score AS lo", "score AS hi", "n", "hits"))
        missing = set(range(self.n_classes)) - {r.k for r in blocks.select("k").distinct().collect()}
        if missing:
            raise ValueError(f"no scores of classes {sorted(missing)} to fit")
        return IsotonicModel(self, blocks.selectExpr("k", "lo", "hi", "hits / n AS value"))


@dataclass(frozen=True)
class IsotonicModel:
    """``steps`` holds the blocks: class ``k``, scores ``lo`` to ``hi``, ``value``."""

    calibration: IsotonicCalibration
    steps: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the probabilities by calibrated ones and add ``y_pred``."""
        source, n = self.calibration.probs, self.calibration.n_classes
        raw = self._sent(df) if self.steps.limit(SENT_BLOCKS + 1).count() <= SENT_BLOCKS else self._joined(df)
        return (
            raw.withColumn(source, F.when(F.col("_raw").isNotNull(), F.expr(normalised("_raw", n))))
            .select(*[F.col(name(c)) for c in df.columns])
            .withColumn("y_pred", F.expr(argmax(name(source))))
        )

    def _sent(self, df: DataFrame) -> DataFrame:
        n = self.calibration.n_classes
        rows = self.steps.orderBy("k", "lo").collect()
        points = []
        for k in range(n):
            own = [r for r in rows if r.k == k]
            xy = [(r.lo, r.value) for r in own] + [(r.hi, r.value) for r in own if r.hi > r.lo]
            points.append(np.array(sorted(xy)).T)

        @F.arrow_udf("array<double>")
        def calibrated(scores: pa.Array) -> pa.Array:
            x = matrix(scores, n)
            out = list_column(np.stack([np.interp(x[:, k], *points[k]) for k in range(n)], axis=1))
            return pa.ListArray.from_arrays(out.offsets, out.values, mask=scores.is_null()) if scores.null_count else out

        return df.withColumn("_raw", calibrated(F.col(name(self.calibration.probs)).cast("array<double>")))

    def _joined(self, df: DataFrame) -> DataFrame:
        """Each class's score is joined with the range of blocks around it; ranges hold ``RANGE_BLOCKS`` blocks at most."""
        n = self.calibration.n_classes
        ranges = self._ranges()
        starts = {k: [] for k in range(n)}
        for r in ranges.select("k", "start").orderBy("k", "start").collect():  # one of RANGE_BLOCKS blocks
            starts[r.k].append(r.start)
        bounds = [np.array(starts[k][1:]) for k in range(n)]

        @F.arrow_udf("array<int>")
        def places(scores: pa.Array) -> pa.Array:
            x = matrix(scores, n)
            return list_column(np.stack([np.searchsorted(bounds[k], x[:, k], "right") for k in range(n)], axis=1).astype(np.int32))

        df = df.withColumn("_places", places(F.col(name(self.calibration.probs)).cast("array<double>")))
        numbered = ranges.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("start")) - 1)
        numbered = materialize(numbered.select("k", "place", "points"), "ranges")
        for k in range(n):
            own = numbered.where(f"k = {k}").select(F.col("place").alias(f"_place{k}"), F.col("points").alias(f"_points{k}"))
            df = df.join(own, F.col("_places")[k] == F.col(f"_place{k}"), "left")
        values = []
        for k in range(n):
            s = f"{name(self.calibration.probs)}[{k}]"
            low = f"try_element_at(filter(_points{k}, p -> p.x <= {s}), -1)"
            high = f"get(filter(_points{k}, p -> p.x > {s}), 0)"
            values.append(
                f"CASE WHEN {low}.x IS NULL THEN {high}.y WHEN {high}.x IS NULL THEN {low}.y"
                f" ELSE ({high}.y - {low}.y) / ({high}.x - {low}.x) * ({s} - {low}.x) + {low}.y END"
            )
        raw = f"IF({name(self.calibration.probs)} IS NULL, NULL, {array(values)})"
        return df.withColumn("_raw", F.expr(raw))

    def _ranges(self) -> DataFrame:
        """``k, start, points``: the points of at most ``RANGE_BLOCKS`` blocks in order, and the next one's first."""
        size = RANGE_BLOCKS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ks, lo, hi, value = (batch.column(c).to_numpy() for c in ("k", "lo", "hi", "value"))
                rows = []
                for k in np.unique(ks).tolist():
                    own = np.flatnonzero(ks == k)
                    for at in range(0, len(own), size):
                        some = own[at : at + size]
                        points = [{"x": x, "y": y} for a, b, y in zip(lo[some], hi[some], value[some]) for x in ([a, b] if b > a else [a])]
                        rows.append({"k": k, "start": float(lo[some[0]]), "first": float(value[some[0]]), "points": points})
                kinds = pa.schema([
                    ("k", pa.int32()), ("start", pa.float64()), ("first", pa.float64()),
                    ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
                ])
                yield pa.RecordBatch.from_pylist(rows, kinds)

        # Files of ``steps`` hold ranges of scores, each in order.
        placed = self.steps.repartitionByRange("k", "lo").sortWithinPartitions("k", "lo").select("k", "lo", "hi", "value")
        ranges = placed.mapInArrow(run, "k int, start double, first double, points array<struct<x:double,y:double>>")
        ranges = materialize(ranges, "ranges")
        following = Window.partitionBy("k").orderBy("start")
        next_point = F.struct(F.lead("start").over(following).alias("x"), F.lead("first").over(following).alias("y"))
        ranges = ranges.withColumn("next", next_point)
        return ranges.selectExpr("k", "start", "IF(next.x IS NULL, points, concat(points, array(next))) AS points")


@dataclass(frozen=True)
class CrossCalibration:
    """A learner and its isotonic calibration on ``k`` folds: each part is fitted without a fold and calibrated on it.

    The result is the mean of the parts. ``learner`` has ``fit``; its models add the class probabilities as the array
    column ``block``, or as MLlib's vector column ``probability`` if ``block`` is None. Folds are stratified by class and depend on
    ``row_id`` and ``seed`` only.
    """

    learner: object
    n_classes: int
    k: int = 3
    block: str | None = None
    target: str = "y"
    row_id: str = "row_id"
    seed: int = 42

    def fit(self, df: DataFrame) -> CrossCalibratedModel:
        ranked = hash_rank(df, self.row_id, self.target, self.seed, rank="_rank", size="_size")
        folds = ranked.withColumn("_fold", F.expr(f"cast((_rank - 1) % {self.k} AS int)")).drop("_rank", "_size")
        folds = materialize(folds, "calibration")
        parts = []
        for f in range(self.k):
            others, own = (folds.where(c).drop("_fold") for c in (f"_fold <> {f}", f"_fold = {f}"))
            part = _Part(self.learner.fit(others), self.block, self.n_classes)
            scored = materialize(part.scored(own).select(F.col(name(self.target)).alias("y"), "_block"), "scored")
            parts.append(replace(part, isotonic=IsotonicCalibration(self.n_classes, "_block").fit(scored)))
        return CrossCalibratedModel(self, tuple(parts))


@dataclass(frozen=True)
class _Part:
    model: object
    block: str | None
    n_classes: int
    isotonic: IsotonicModel | None = None

    def scored(self, df: DataFrame) -> DataFrame:
        """All columns of ``df`` and the array ``_block``."""
        from gradeloom.operators.stack import score_blocks

        if self.block is None:
            return score_blocks(df, {"_block": self.model}, self.n_classes)
        return self.model.transform(df).select(*[F.col(name(c)) for c in df.columns], F.col(name(self.block)).alias("_block"))


@dataclass(frozen=True)
class CrossCalibratedModel:
    calibration: CrossCalibration
    parts: tuple[_Part, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability array<double>``, the mean of the calibrated parts; an older column of that name is replaced."""
        columns = [c for c in df.columns if c != "probability"]
        for k, part in enumerate(self.parts):
            df = part.isotonic.transform(part.scored(df)).drop("y_pred").withColumnRenamed("_block", f"_block{k}")
        blocks = [f"_block{k}" for k in range(len(self.parts))]
        mean = array(f"({' + '.join(f'{b}[{c}]' for b in blocks)}) / {len(blocks)}" for c in range(self.calibration.n_classes))
        return df.select(*[F.col(name(c)) for c in columns], F.expr(mean).alias("probability"))

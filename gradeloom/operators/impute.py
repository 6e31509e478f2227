"""Median and mode imputation, standard scaling and table reports."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, functions as F

from gradeloom.functions.survey import nan_to_null
from gradeloom.functions.text import array, name, number, text
from gradeloom.sources.shared import materialize


def exact_medians(df: DataFrame, columns: list[str], bins: int = 4096) -> dict[str, float | None]:
    """Exact interpolated medians of ``columns``, ignoring NULL and NaN; infinite values count.

    A built-in median keeps all distinct values of a column in one task. Here the columns are stored
    once, and every pass over them counts the values of all columns in ``bins`` intervals and keeps the
    interval of the middle rank, with the true extremes of its values as next bounds. A pass returns at
    most ``bins`` rows per column. Intervals are cut by logarithm until both ends are of one size, then
    evenly, so a handful of passes settles any column, however far its values spread.
    """
    values = materialize(
        df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]),
        "medians",
    )
    finite = "abs(v{0}) < double('Infinity')"
    ends = values.agg(
        *[
            F.expr(e.format(i) + f" AS {label}{i}")
            for i in range(len(columns))
            for label, e in (
                ("lowest", "count_if(v{0} = double('-Infinity'))"),
                ("highest", "count_if(v{0} = double('Infinity'))"),
                ("n", f"count_if({finite})"),
                ("lo", f"min(v{{0}}) FILTER (WHERE {finite})"),
                ("hi", f"max(v{{0}}) FILTER (WHERE {finite})"),
            )
        ]
    ).first()
    found: dict[int, list[float]] = {}
    open_: dict[int, _Interval] = {}
    for i in range(len(columns)):
        bars = [
            Row(n=ends[f"lowest{i}"], lo=-math.inf, hi=-math.inf),
            Row(n=ends[f"n{i}"], lo=ends[f"lo{i}"], hi=ends[f"hi{i}"]),
            Row(n=ends[f"highest{i}"], lo=math.inf, hi=math.inf),
        ]
        n = sum(bar.n for bar in bars)
        ranks = sorted({(n + 1) // 2, n // 2 + 1}) if n else []
        found[i] = []
        _settle(found[i], open_, i, ranks, bars, 0)
    while open_:
        spans = []
        for i, gap in open_.items():
            v, lo, hi = f"v{i}", number(gap.lo), number(gap.hi)
            inside = f"{v} BETWEEN {lo} AND {hi}"
            spans += [str(i), f"if({inside}, {v}, NULL)", f"if({inside}, {_bin(v, gap.lo, gap.hi, bins)}, NULL)"]
        rows = (
            values.selectExpr(f"stack({len(open_)}, {', '.join(spans)}) AS (i, v, bin)")
            .filter(F.col("v").isNotNull())
            .groupBy("i", "bin")
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        previous, open_ = open_, {}
        for i, gap in previous.items():
            bars = sorted((r for r in rows if r.i == i), key=lambda r: r.bin)
            _settle(found[i], open_, i, gap.ranks, bars, gap.below)
    return {c: _middle(found[i]) for i, c in enumerate(columns)}


def _middle(ends: list[float]) -> float | None:
    if not ends:
        return None
    return ends[0] if len(set(ends)) == 1 else 0.5 * ends[0] + 0.5 * ends[-1]


def _bin(v: str, lo: float, hi: float, bins: int) -> str:
    """Number of the interval that a finite value between ``lo`` and ``hi`` falls into; grows with the value."""
    if lo * hi > 0 and 0.25 <= abs(lo) / abs(hi) <= 4:
        half = 0.5  # keeps differences finite
        place, start, width = f"{v} * {half}D", lo * half, hi * half - lo * half
    else:

        def size(x: float) -> float:
            return math.copysign(math.log(abs(x)) + 746, x) if x else 0.0

        place = f"if({v} = 0, 0.0D, signum({v}) * (ln(abs({v})) + 746))"
        start, width = size(lo), size(hi) - size(lo)
    if width == 0:  # neighbours that differ in their last digit only
        return f"int({v} > {number(lo)})"
    return f"greatest(0, least(floor(({place} - {number(start)}) / {number(width)} * {bins}), {bins - 1}))"


@dataclass
class _Interval:
    lo: float
    hi: float
    below: int
    ranks: list[int]


def _settle(found: list, open_: dict, i: int, ranks: list[int], bars: list[Row], below: int) -> None:
    """Read off ranks that are the end of a bar; leave the bar of the others open."""
    for bar in bars:
        here = [r for r in ranks if below < r <= below + bar.n]
        for r in here:
            if bar.lo == bar.hi or r == below + 1:
                found.append(bar.lo)
            elif r == below + bar.n:
                found.append(bar.hi)
            elif i in open_:
                open_[i].ranks.append(r)
            else:
                open_[i] = _Interval(bar.lo, bar.hi, below, [r])
        below += bar.n


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties; NULL and NaN do not count.

    One scan counts the values of all columns, spread over tasks by value. The second aggregate
    sees one row per distinct value, combines map-side and compares values in their own type.
    """
    counts = (
        column_values(df, columns)
        .filter("v IS NOT NULL")
        .groupBy("i", "v")
        .agg(F.count("*").alias("n"))
    )
    kinds = dict(df.dtypes)
    best = [
        f"min(if(i = {i}, struct(-n AS n, cast(v AS {kinds[c]}) AS v), NULL)) AS v{i}"
        for i, c in enumerate(columns)
    ]
    row = counts.agg(*[F.expr(e) for e in best]).first()
    return {c: row[f"v{i}"].v if row[f"v{i}"] else None for i, c in enumerate(columns)}


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, v)``: position of the column and value as text, which keeps every digit; one row per cell.

    NaN becomes NULL and negative zero becomes zero.
    """
    kinds = dict(df.dtypes)

    def cell(c: str) -> str:
        real = kinds[c] in ("double", "float")
        return f"cast({f'nanvl({name(c)}, NULL) + 0.0D' if real else name(c)} AS string)"

    cells = ", ".join(f"{i}, {cell(c)}" for i, c in enumerate(columns))
    return df.selectExpr(f"stack({len(columns)}, {cells}) AS (i, v)")


@dataclass(frozen=True)
class Imputer:
    """Median for some columns, mode for others; fitted on one table, applied to any."""

    median: tuple[str, ...] = ()
    mode: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> ImputerModel:
        fills = exact_medians(df, list(self.median)) if self.median else {}
        if self.mode:
            fills |= modes(df, list(self.mode))
        empty = [c for c, v in fills.items() if v is None]
        if empty:
            raise ValueError(f"columns without any value: {empty}")
        return ImputerModel(fills, frozenset(self.median))


@dataclass(frozen=True)
class ImputerModel:
    fills: dict[str, object]
    numeric: frozenset[str] = field(default_factory=frozenset)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace NULL and NaN. Median columns become doubles, as a median may fall between values."""
        kinds = dict(df.dtypes)
        filled = {}
        for c, value in self.fills.items():
            old = F.col(f"`{c}`")
            if c in self.numeric:
                old = nan_to_null(old.cast("double"))
            elif kinds[c] in ("double", "float"):
                old = nan_to_null(old)
            filled[c] = F.coalesce(old, F.lit(value))
        return df.withColumns(filled)


def fit_impute(df: DataFrame, median: list[str], mode: list[str]) -> ImputerModel:
    return Imputer(tuple(median), tuple(mode)).fit(df)


@dataclass(frozen=True)
class ScalerModel:
    """Means and population deviations of columns."""

    moments: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Subtract the mean and divide by the deviation; a constant column becomes 0."""
        return df.withColumns(
            {
                c: (F.col(f"`{c}`") - F.lit(mean)) / F.lit(deviation or 1.0)
                for c, (mean, deviation) in self.moments.items()
            }
        )


def fit_scaler(df: DataFrame, columns: list[str]) -> ScalerModel:
    row = df.agg(
        *[
            f(f"`{c}`").alias(f"{f.__name__}{i}")
            for i, c in enumerate(columns)
            for f in (F.avg, F.stddev_pop)
        ]
    ).first()
    return ScalerModel({c: (row[f"avg{i}"], row[f"stddev_pop{i}"]) for i, c in enumerate(columns)})


def describe_columns(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per column: rows, non-null values, distinct values, smallest and largest value.

    Exact distinct counts shuffle the values of each column; ``approximate`` needs a single pass.
    """
    distinct = "approx_count_distinct(" if approximate else "count(DISTINCT "
    kept = [f"cast({name(c)} AS double)" for c in columns]
    wide = df.agg(
        F.count("*").alias("n_rows"),
        *[F.expr(f"count({v}) AS n{i}") for i, v in enumerate(kept)],
        *[F.expr(f"{distinct}{v}) AS d{i}") for i, v in enumerate(kept)],
        *[F.expr(f"min({v}) AS lo{i}") for i, v in enumerate(kept)],
        *[F.expr(f"max({v}) AS hi{i}") for i, v in enumerate(kept)],
    )
    rows = array(
        f"struct({text(c)} AS column, n_rows, n{i} AS n_values, d{i} AS n_distinct,"
        f" lo{i} AS lowest, hi{i} AS highest)"
        for i, c in enumerate(columns)
    )
    return wide.selectExpr(f"inline({rows})")


def drop_unlabelled(df: DataFrame, target: str) -> tuple[DataFrame, Observation]:
    """Rows with a target, and an observation of ``rows_before`` and ``rows_unlabelled``.

    The counts are filled by the first action on the returned table, so the data is read once.
    """
    seen = Observation()
    counted = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col(target).isNull()).alias("rows_unlabelled"),
    )
    return counted.filter(F.col(target).isNotNull()), seen

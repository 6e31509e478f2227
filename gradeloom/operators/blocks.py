"""Probability blocks of several models: long and wide tables, lookups, completeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.text import array, name, text
from gradeloom.sources.shared import materialize


def wide_blocks(
    pred: DataFrame, models: list[str], n_classes: int, keep: tuple[str, ...] = ("y",)
) -> DataFrame:
    """One row per ``row_id`` with an array column per model, from a long prediction table.

    The only shuffle is on ``row_id``. Elements are aggregated as scalars, which hash-aggregates
    without sorting. A model that is absent or doubled for a row is an error.
    """
    is_model = [f"model = {text(m)}" for m in models]
    wide = (
        pred.filter(F.col("model").isin(models))
        .groupBy("row_id")
        .agg(
            *[F.max(c).alias(c) for c in keep],
            *[F.expr(f"count_if({hit}) AS _n{i}") for i, hit in enumerate(is_model)],
            *[
                F.expr(f"max(if({hit}, probs[{k}], NULL)) AS _p{i}_{k}")
                for i, hit in enumerate(is_model)
                for k in range(n_classes)
            ],
        )
    )
    whole = " AND ".join(f"_n{i} = 1" for i in range(len(models)))
    fault = "raise_error(concat('row without exactly one prediction per model: ', row_id))"
    return wide.selectExpr(
        "row_id",
        *keep,
        *[
            f"CASE WHEN {whole} THEN {array(f'_p{i}_{k}' for k in range(n_classes))} ELSE {fault} END AS {name(m)}"
            for i, m in enumerate(models)
        ],
    )


def long_blocks(wide: DataFrame, models: list[str], keep: tuple[str, ...] = ("row_id", "y")) -> DataFrame:
    """Long prediction table from array columns named after the models; no shuffle."""
    return wide.select(
        *keep,
        F.expr(f"inline({array(f'struct({text(m)} AS model, {name(m)} AS probs)' for m in models)})"),
    )


def scatter_folds(scored: list[DataFrame]) -> DataFrame:
    """Out-of-fold table from the scored held-out parts, keyed by ``row_id``."""
    union = scored[0]
    for part in scored[1:]:
        union = union.unionByName(part)
    return union


def unscored_rows(rows: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows of ``rows`` without a prediction; empty when an out-of-fold table is complete."""
    return rows.join(pred.select("row_id"), "row_id", "left_anti")


def join_on_row(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns of two tables side by side, matched by key instead of by position."""
    return left.join(right, row_id)


def compute_per_distinct(
    df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run a costly computation once per distinct ``key`` and look its columns up for every row.

    ``compute`` takes a table of distinct keys and returns it with more columns. The result is stored,
    so it is computed once and joined by its true size. Use the original value as key, never one
    recomputed in floating point.
    """
    looked_up = materialize(compute(df.select(key).filter(F.col(key).isNotNull()).distinct()), "lookup")
    return df.join(looked_up, key, "left")

"""Reproducible hold-out splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.text import number
from gradeloom.operators.ranking import hash_rank


def holdout_split(
    df: DataFrame,
    row_id: str,
    stratum: str | None = None,
    test: float = 0.3,
    valid: float = 0.0,
    seed: int = 42,
    folds: int = 0,
) -> DataFrame:
    """Add ``split``: ``test`` takes its share of every stratum, ``valid`` its share of the rest.

    With ``folds`` the column ``fold`` is added as by :func:`stratified_folds`; one ranking serves all
    cuts. Without ``stratum`` the whole table is one stratum; its rank is still computed in hash
    buckets, so no task sorts the table.
    """
    ranked = hash_rank(df, row_id, stratum, seed, rank="_rank", size="_size")
    cut = ranked.withColumn("_cut", F.expr(f"floor(_size * {number(test)} + 0.5D)"))
    split = cut.withColumn(
        "split",
        F.expr(
            "CASE WHEN _rank <= _cut THEN 'test'"
            f" WHEN _rank <= _cut + floor((_size - _cut) * {number(valid)} + 0.5D) THEN 'valid'"
            " ELSE 'train' END"
        ),
    )
    if folds:
        split = split.withColumn("fold", F.expr(f"cast((_rank - 1) % {folds} AS int)"))
    return split.drop("_rank", "_size", "_cut")


def stratified_folds(
    df: DataFrame, row_id: str, stratum: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` in 0..k-1; per stratum the fold sizes differ by one at most."""
    ranked = hash_rank(df, row_id, stratum, seed, rank="_rank", size="_size")
    return ranked.withColumn("fold", F.expr(f"cast((_rank - 1) % {k} AS int)")).drop("_rank", "_size")


def train_and_valid(df: DataFrame) -> DataFrame:
    """Rows of the training and validation parts; both live in one table, so no union is needed."""
    return df.filter(F.col("split").isin("train", "valid"))


def union_splits(*parts: DataFrame) -> DataFrame:
    """Union of parts kept as separate tables, matched by column name."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union

"""Exact ranks and running sums that never put a whole group into one task."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.text import name
from gradeloom.sources.shared import materialize


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_rank(
    df: DataFrame,
    row_id: str,
    stratum: str | None = None,
    seed: int = 42,
    digits: int | None = None,
    rank: str = "rank",
    size: str = "stratum_size",
) -> DataFrame:
    """Add the 1-based rank of a row inside its stratum, in the order of a seeded hash of ``row_id``.

    The result depends on the data and the seed only, not on partitions. A window over a stratum
    would sort a class, perhaps a third of all rows, in one task. Instead rows are sorted inside
    ``16**digits`` hash buckets per stratum, and bucket counts give the offsets: the leading hash
    digits order the buckets, so both steps together are the exact rank, whatever their number. By
    default there are at least 16 buckets per shuffle partition. The join with the offsets has the keys
    of the window, so it needs no further shuffle of the rows. ``df`` is evaluated twice, the first time
    for two columns only. ``row_id`` must be unique.
    """
    digits = digits or math.ceil(math.log(16 * _partitions(df), 16))
    # Never NULL and different for every stratum, so that window and join share one partitioning.
    group = "''" if stratum is None else f"coalesce(concat('=', cast({name(stratum)} AS string)), '')"
    hashed = df.selectExpr(
        "*",
        f"{group} AS _stratum",
        f"md5(concat('{seed}:', cast({name(row_id)} AS string))) AS _hash",
    ).withColumn("_bucket", F.substring("_hash", 1, digits))
    offsets = (
        hashed.groupBy(F.col("_stratum").alias("_s"), F.col("_bucket").alias("_b"))
        .agg(F.count("*").alias("_n"))
        .select(
            "_s",
            "_b",
            (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).alias("_before"),
            F.sum("_n").over(Window.partitionBy("_s")).alias(size),
        )
    )
    in_bucket = Window.partitionBy("_stratum", "_bucket").orderBy("_hash", row_id)
    return (
        hashed.withColumn("_rn", F.row_number().over(in_bucket))
        .join(offsets, (F.col("_stratum") == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        .withColumn(rank, F.col("_rn") + F.col("_before"))
        .drop("_stratum", "_hash", "_bucket", "_s", "_b", "_rn", "_before")
    )


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Add, per group of ``keys``, exclusive running sums over the rows in the order of ``order``.

    ``sums`` maps a new column to what it adds up. Rows are placed by range, so a huge group is spread
    over many tasks; the sums of the ranges give the offsets. The placement is written out, because a
    recomputed range partitioning may cut elsewhere. ``order`` must be unique within a group and the
    keys must not be NULL; the join with the offsets then reuses the partitioning of the window.
    """
    ranges = [partitions] if partitions else []  # left open, adaptive execution merges small ranges
    placed = materialize(
        df.repartitionByRange(*ranges, *keys, order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    offsets = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{s}") for s, c in sums.items()])
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = offsets.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(s) for s, c in sums.items()]
    )
    same_range = reduce(
        and_,
        [F.col(k) == F.col(f"_k_{k}") for k in keys],
        F.col("_part") == F.col("_p"),
    )
    return (
        within.join(offsets, same_range)
        .withColumns({s: F.col(s) + F.col(f"_{s}") for s in sums})
        .select(*df.columns, *sums)
    )

"""Bounded samples for fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.sources.shared import materialize


def by_hash(rows: DataFrame, column: str, most: int) -> DataFrame:
    """A row for each of the smallest values of ``column``, an even 64-bit hash; ``most`` of them, or fewer.

    Rows are counted first, and those far above the bound are filtered where they are read: of any table about
    ``most`` rows are sorted. Of rows that share a hash (copies) one is taken. The input is evaluated twice, for
    the count with as few columns as it needs.
    """
    n = rows.count()
    if n > 2 * most:
        bound = -(1 << 63) + int((1 << 64) * 1.2 * most / n)
        rows = rows.where(f"`{column}` <= {bound}L")
    return rows.dropDuplicates([column]).orderBy(column).limit(most)


def by_hash_of_each(rows: DataFrame, column: str, group: str, most: int) -> DataFrame:
    """As ``by_hash``, with an even share of ``most`` rows for each value of ``group``, or all that it has.

    The counts of the groups are a stored table of one row each; rows far above a group's share are filtered by it
    where they are read, and the rest is cut down to the share before it is shuffled.
    """
    counts = materialize(rows.groupBy(group).count().withColumnRenamed("count", "of_group"), "counts")
    share = max(1, most // max(1, counts.count()))
    enough = 1.2 * share + 100  # rows below the bound, as expected: far more than the share
    near = f"of_group <= {enough!r}D OR `{column}` / 18446744073709551616D + 0.5D <= {enough!r}D / of_group"
    some = rows.join(counts, group).where(near).drop("of_group").dropDuplicates([group, column])
    place = F.row_number().over(Window.partitionBy(group).orderBy(column))
    some = some.withColumn("of_group", place).where(f"of_group <= {share}").drop("of_group")
    return some.orderBy(column).limit(most)

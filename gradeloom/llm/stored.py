"""Stored tables of a loop's rounds, which may be removed before the loop ends, and Arrow batches bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gradeloom.sources.shared import new_table_path

#: Bytes of rows that a task hands to Python at once; a longer row is handed over alone.
ARROW_BYTES = 2 << 20
#: The same for sessions whose tasks gain from many texts at once.
SESSION_ARROW_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def store(df: DataFrame, label: str, row_group_bytes: int | None = None) -> tuple[str, DataFrame]:
    """Write ``df`` to a new folder of the shared ones; its path, and the table as read from there."""
    path = new_table_path(df.sparkSession, label)
    writer = df.write if row_group_bytes is None else df.write.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing will read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession, most: int = SESSION_ARROW_BYTES) -> None:
    """From now on the session hands rows to Python in batches of about ``most`` bytes, or fewer if it is set so."""
    before = spark.conf.get(_LIMIT, None)
    if before is None or not before.isdigit() or int(before) > most:
        spark.conf.set(_LIMIT, str(most))


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Jobs started inside hand rows to Python in batches of about ``most`` bytes, if the session has no lower limit."""
    before = spark.conf.get(_LIMIT, None)
    if before is not None and before.isdigit() and int(before) <= most:
        yield
        return
    spark.conf.set(_LIMIT, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_LIMIT) if before is None else spark.conf.set(_LIMIT, before)

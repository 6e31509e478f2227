"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without the setting; it then gets a temporary folder. On a cluster
    a machine-local folder would be lost with its executor, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="gradeloom-")
    return _local_folders[context.applicationId]


def new_table_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/gradeloom/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside when the block ends.

    Results and fitted models that read them must have been used up or written elsewhere by then. Without
    this block the tables stay, since only the caller knows how long a lazy result is needed.
    """
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in scope:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str = "table", **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with the writer's ``options``, and read it back.

    This cuts the lineage, survives the loss of executors, and gives Catalyst the true size on disk:
    joins with the result are broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled
    above it, with no hint in the code.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory and on disk for several passes; a cache of the caller's is left alone."""
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    if own:
        df = df.persist()
    try:
        yield df
    finally:
        if own:
            df.unpersist()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def files_of_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside remove the files of their shuffles when they end; a lazy result must not be used again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Jobs started inside hand rows to Python in Arrow batches of about ``most`` bytes, or fewer if the session says so; a longer row goes alone.

    Without it, rows that are blocks of megabytes are handed over by the partition.
    """
    before = spark.conf.get(_BATCH, None)
    if before is not None and before.isdigit() and 0 < int(before) <= most:
        yield
        return
    spark.conf.set(_BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)

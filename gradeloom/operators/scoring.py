"""Scoring with a model that only predicts, such as a network trained elsewhere."""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

_loaded: dict[str, Callable] = {}


def score_in_batches(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
    keep: list[str],
    features: list[str],
    output: str = "logits",
    token: str | None = None,
) -> DataFrame:
    """Add ``output``, the rows of the matrix that the loaded function returns for a batch.

    ``load`` runs on the executors, once per task, or once per Python worker if ``token`` names the
    model. Only ``keep`` and ``features`` travel to Python; the batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``. Turn logits into probabilities afterwards with
    the JVM-side softmax.
    """
    rows = df.select(*dict.fromkeys([*keep, *features]))
    schema = StructType(
        [rows.schema[c] for c in keep] + [StructField(output, ArrayType(DoubleType()))]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = _loaded.get(token) if token else None
        if predict is None:
            predict = load()
            if token:
                _loaded[token] = predict
        for batch in batches:
            block = np.asarray(predict(batch[features]), dtype="float64")
            if block.ndim != 2 or len(block) != len(batch):
                raise ValueError(f"expected one row of outputs per input row, got shape {block.shape}")
            yield batch[keep].assign(**{output: list(block)})

    return rows.mapInPandas(score, schema)


def write_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> str:
    """Write named arrays as one file, in any file system that Spark knows; returns its SHA-256."""
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    data = buffer.getvalue()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return hashlib.sha256(data).hexdigest()


def score_with_file(
    df: DataFrame,
    path: str,
    sha256: str,
    build: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray], np.ndarray]],
    keep: list[str],
    features: list[str],
    output: str = "logits",
    chunk_rows: int = 256,
) -> DataFrame:
    """Add ``output`` from a model whose arrays lie in one file, as :func:`write_arrays` made it.

    Spark sends the file to every executor. A Python worker reads it once, raises if its SHA-256 is another one, and calls
    ``build`` with the arrays; the function it returns gets float64 matrices of at most ``chunk_rows`` rows, whatever the size of
    the Arrow batches. Null features are NaN.
    """
    df.sparkSession.sparkContext.addFile(path)
    file = path.rstrip("/").rsplit("/", 1)[-1]

    def load() -> Callable[[pd.DataFrame], np.ndarray]:
        with open(os.path.join(SparkFiles.getRootDirectory(), file), "rb") as f:
            data = f.read()
        found = hashlib.sha256(data).hexdigest()
        if found != sha256:
            raise ValueError(f"model file {file} has the checksum {found}, not {sha256}")
        with np.load(io.BytesIO(data)) as arrays:
            predict = build({k: arrays[k] for k in arrays.files})

        def chunks(batch: pd.DataFrame) -> np.ndarray:
            rows = batch.to_numpy(dtype="float64")
            parts = [np.asarray(predict(rows[at : at + chunk_rows])) for at in range(0, len(rows), chunk_rows)]
            return np.concatenate(parts) if parts else np.zeros((0, 0))

        return chunks

    return score_in_batches(df, load, keep, features, output, token=f"{file}:{sha256}:{chunk_rows}")

"""Base of the library's own learners: MLlib estimators and models, so that they go into pipelines and searches.

A fitted model is a set of NumPy arrays. It is stored as one small Parquet table beside the usual metadata and
predicts in Arrow batches; only the feature column travels to Python.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.text import name

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feature_array(df: DataFrame, column: str) -> Column:
    """A feature column as ``array<double>``, whether it is a vector or an array."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(F.col(name(column)))
    return F.col(name(column)).cast("array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; null rows and null elements are NaN. Raises if a row has another length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if (sizes[there] != width).any():
        raise ValueError(f"expected {width} features in every row")
    out = np.full((len(column), width), np.nan)
    out[there] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def list_column(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def width_of(df: DataFrame, column: str) -> int:
    """Number of features of the rows; raises if there are none or if they differ."""
    sizes = df.select(F.size(feature_array(df, column)).alias("n")).where("n >= 0")
    found = sizes.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if found.a is None:
        raise ValueError("there are no rows to learn from")
    if found.a != found.b:
        raise ValueError(f"rows have {found.a} to {found.b} features")
    return found.a


class _ArraysWriter(MLWriter):
    def __init__(self, instance: ArraysModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(k, a.dtype.str, list(a.shape), a.tobytes()) for k, a in self.instance.arrays.items()]
        table = self.sparkSession.createDataFrame(rows, "name string, kind string, shape array<int>, data binary")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")


class _ArraysReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ArraysModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/arrays").collect()
        model = self.kind({r.name: np.frombuffer(bytes(r.data), r.kind).reshape(r["shape"]) for r in rows})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class ArraysModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLReadable, MLWritable):
    """A classifier whose parameters are arrays. Subclasses give ``numClasses``, ``numFeatures`` and ``scorer``."""

    def __init__(self, arrays: dict[str, np.ndarray] | None = None) -> None:
        super().__init__()
        self.arrays = arrays or {}

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """Function from a feature matrix to class probabilities; it is shipped to the tasks."""
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _ArraysWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ArraysReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score, width = self.scorer(), self.numFeatures

        @F.arrow_udf("array<double>")
        def probabilities(features: pa.Array) -> pa.Array:
            return list_column(score(matrix(features, width)))

        scored = dataset.withColumn("_probabilities", probabilities(feature_array(dataset, self.getFeaturesCol())))
        first_best = F.array_position("_probabilities", F.array_max("_probabilities")) - 1
        return (
            scored.withColumn(self.getProbabilityCol(), array_to_vector("_probabilities"))
            .withColumn(self.getPredictionCol(), first_best.cast("double"))
            .drop("_probabilities")
        )

"""Fitted models in one folder: learners, tables and numbers, to be scored with in another session."""

from __future__ import annotations

import dataclasses
import importlib
import json
import math

import numpy as np
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
PACKAGE = "gradeloom."


def save_model(spark: SparkSession, model: object, path: str) -> None:
    """Write a fitted model to ``path``, which is replaced.

    Models are the library's dataclasses, in any nesting. Tables go to Parquet, learners to their own format,
    everything else into one row of text. The last write is that row, so a folder without it is no model. Raises
    ``TypeError`` for parts that cannot be stored, such as functions.
    """
    numbers = iter(range(1_000_000))

    def pack(part: object) -> object:
        if part is None or isinstance(part, (bool, int, str)):
            return part
        if isinstance(part, (float, np.floating)):
            return float(part) if math.isfinite(part) else {"float": repr(float(part))}
        if isinstance(part, np.integer):
            return int(part)
        if isinstance(part, list):
            return [pack(p) for p in part]
        if isinstance(part, (tuple, frozenset)):
            return {type(part).__name__: [pack(p) for p in part]}
        if isinstance(part, dict):
            return {"dict": [[pack(k), pack(v)] for k, v in part.items()]}
        if isinstance(part, DataFrame):
            part.write.mode("overwrite").parquet(f"{path}/part-{(n := next(numbers))}")
            return {"table": n, "schema": part.schema.json()}
        if isinstance(part, MLWritable):
            part.write().overwrite().save(f"{path}/part-{(n := next(numbers))}")
            return {"learner": n}
        kind = type(part)
        if dataclasses.is_dataclass(part) and kind.__module__.startswith(PACKAGE):
            fields = {f.name: pack(getattr(part, f.name)) for f in dataclasses.fields(part)}
            return {"object": [kind.__module__, kind.__qualname__], "fields": fields}
        raise TypeError(f"a {kind.__name__} cannot be stored")

    text = json.dumps({"version": VERSION, "model": pack(model)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> object:
    """Read what :func:`save_model` wrote. Only classes of this library and learners are made."""
    stored = json.loads(spark.read.parquet(f"{path}/model").first().value)
    if stored["version"] != VERSION:
        raise ValueError(f"model of version {stored['version']}, this library reads {VERSION}")

    def unpack(part: object) -> object:
        if isinstance(part, list):
            return [unpack(p) for p in part]
        if not isinstance(part, dict):
            return part
        if "float" in part:
            return float(part["float"])
        if "tuple" in part:
            return tuple(unpack(p) for p in part["tuple"])
        if "frozenset" in part:
            return frozenset(unpack(p) for p in part["frozenset"])
        if "dict" in part:
            return {unpack(k): unpack(v) for k, v in part["dict"]}
        if "table" in part:
            return spark.read.parquet(f"{path}/part-{part['table']}")
        if "learner" in part:
            return DefaultParamsReader.loadParamsInstance(f"{path}/part-{part['learner']}", spark)
        module, name = part["object"]
        if not module.startswith(PACKAGE):
            raise ValueError(f"{module} is not part of this library")
        kind = getattr(importlib.import_module(module), name)
        return kind(**{k: unpack(v) for k, v in part["fields"].items()})

    return unpack(stored["model"])

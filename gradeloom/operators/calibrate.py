"""Calibration of class probabilities on rows kept apart for it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.probability import argmax, log_sum_exp, normalised, softmax
from gradeloom.functions.text import array, name, number, pick, slots, total
from gradeloom.operators.isotonic import IsotonicCalibration, IsotonicModel
from gradeloom.sources.shared import cached

MIN_TEMPERATURE, MAX_TEMPERATURE = 1e-6, 1e6


def temperature_losses(
    df: DataFrame, logits: str, y: str, n_classes: int, temperatures: list[float]
) -> DataFrame:
    """Mean negative log likelihood per temperature, in one pass over the logits.

    The temperatures are a literal list, so their number does not depend on the data.
    """
    rows = df.selectExpr(
        f"{name(y)} AS y",
        f"{name(logits)} AS z",
        f"explode({array(number(t) for t in temperatures)}) AS temperature",
    )
    scaled = rows.selectExpr(
        "temperature", "y", f"{array(f'{z} / temperature' for z in slots('z', n_classes))} AS z"
    )
    loss = f"{log_sum_exp('z', n_classes)} - {pick('y', slots('z', n_classes))}"
    return scaled.groupBy("temperature").agg(F.expr(f"avg({loss}) AS nll"))


def newton_terms(rows: DataFrame, n: int, inverse: float) -> DataFrame:
    """First two derivatives of the mean loss in ``b = 1/T``: E[z]-z_y and Var[z] under softmax(bz).

    ``rows`` is ``(z, y)``; the result is one row.
    """
    z = slots("z", n)
    p = slots("p", n)
    scaled = rows.selectExpr("z", "y", f"{array(f'{v} * {number(inverse)}' for v in z)} AS s")
    shares = scaled.selectExpr("z", "y", f"{softmax('s', n)} AS p")
    moments = shares.selectExpr(
        f"{pick('y', z)} AS own",
        f"{total(f'{a} * {v}' for a, v in zip(p, z))} AS mean",
        f"{total(f'{a} * {v} * {v}' for a, v in zip(p, z))} AS square",
    )
    return moments.agg(F.expr("avg(mean - own) AS slope"), F.expr("avg(square - mean * mean) AS bend"))


@dataclass(frozen=True)
class TemperatureScaling:
    """Temperature that minimises the log loss of ``softmax(z/T)``.

    The loss is convex in ``1/T``, so its slope has one root. Newton steps with one aggregate each
    find it; the sign of the slope keeps a bracket, and a step out of it is replaced by its middle.
    """

    n_classes: int
    logits: str = "logits"
    target: str = "y"
    max_iter: int = 50
    tol: float = 1e-8

    def fit(self, df: DataFrame) -> TemperatureModel:
        with cached(df.select(F.col(self.logits).alias("z"), F.col(self.target).alias("y"))) as rows:
            inverse, converged = self._minimise(rows)
            return TemperatureModel(self, 1.0 / inverse, converged)

    def _minimise(self, rows: DataFrame) -> tuple[float, bool]:
        """The inverse temperature, and whether the search ended at a root inside the bounds."""
        inverse, low, high = 1.0, 1.0 / MAX_TEMPERATURE, 1.0 / MIN_TEMPERATURE
        for _ in range(self.max_iter):
            at = newton_terms(rows, self.n_classes, inverse).first()
            if at.slope is None:
                return 1.0, False
            low, high = (low, inverse) if at.slope > 0 else (inverse, high)
            stepped = inverse - at.slope / at.bend if at.bend and at.bend > 0 else low
            if not low < stepped < high:
                stepped = math.sqrt(low * high)
            moved, inverse = abs(stepped - inverse), stepped
            if moved <= self.tol * inverse:
                return inverse, 1.0 / MAX_TEMPERATURE * 1.01 < inverse < 0.99 / MIN_TEMPERATURE
        return inverse, False


@dataclass(frozen=True)
class TemperatureModel:
    """``converged`` is false if the steps ran out, or if the best temperature lies at a bound or beyond."""

    scaling: TemperatureScaling
    temperature: float
    converged: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probs`` and ``y_pred``; the ranking of the classes does not change."""
        probs = softmax(name(self.scaling.logits), self.scaling.n_classes, number(self.temperature))
        return df.withColumn("probs", F.expr(probs)).withColumn("y_pred", F.expr(argmax("probs")))


__all__ = ["IsotonicCalibration", "IsotonicModel", "TemperatureModel", "TemperatureScaling", "temperature_losses"]

"""Weighted averages of class probabilities and the search for their weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.probability import argmax, argmax_of, at_class, normalised
from gradeloom.functions.text import array, clipped, name, number, slots, text, total
from gradeloom.operators.metrics import (
    auc_one_vs_rest,
    confusion_counts,
    mean_auc,
    summary_scores,
)
from gradeloom.sources.shared import cached

METRIC_COLUMNS = {"accuracy": "accuracy", "f1": "f1_weighted", "f1_macro": "f1_macro", "auc": "auc"}
GRID_STEPS = 10


def normalise_weights(weights: list[float]) -> list[float]:
    """Clip at 0 and divide by the sum; uniform if nothing is left."""
    clipped = [max(float(w), 0.0) for w in weights]
    s = sum(clipped)
    return [w / s for w in clipped] if s > 0 else [1.0 / len(clipped)] * len(clipped)


def normalised_weights(weights: str, n: int) -> Column:
    """As :func:`normalise_weights`, for an array column."""
    inside = [f"({clipped(w, low=0.0)})" for w in slots(weights, n)]
    return F.expr(normalised(array(inside), n))


def blended(models: list[str], weights: list[float], n_classes: int) -> Column:
    """Weighted average of the array columns ``models``; no shuffle."""
    return F.expr(
        array(
            total(f"{number(w)} * {name(m)}[{k}]" for m, w in zip(models, weights))
            for k in range(n_classes)
        )
    )


def blended_long(pred: DataFrame, weights: dict[str, float], n_classes: int) -> DataFrame:
    """Weighted average of a long prediction table, one shuffle on ``row_id``."""
    w = "CASE model " + " ".join(f"WHEN {text(m)} THEN {number(v)}" for m, v in weights.items()) + " END"
    sums = (
        pred.filter(F.col("model").isin(list(weights)))
        .groupBy("row_id")
        .agg(
            F.max("y").alias("y"),
            *[F.expr(f"sum({w} * probs[{k}]) AS _p{k}") for k in range(n_classes)],
        )
    )
    return sums.selectExpr("row_id", "y", f"{array(f'_p{k}' for k in range(n_classes))} AS probs")


def simplex_grid(n_models: int, steps: int = GRID_STEPS) -> list[list[float]]:
    """All weight vectors in multiples of ``1/steps`` that sum to 1, in lexicographic order.

    Counting in whole steps keeps the points on the border, which sums of floats lose.
    """

    def parts(left: int, k: int) -> list[list[int]]:
        if k == 1:
            return [[left]]
        return [[i, *rest] for i in range(left + 1) for rest in parts(left - i, k - 1)]

    return [[i / steps for i in p] for p in parts(steps, n_models)]


def _weighted_classes(n_models: int, n_classes: int) -> list[str]:
    return [total(f"w{i} * b{i}[{k}]" for i in range(n_models)) for k in range(n_classes)]


def _with_candidates(wide: DataFrame, models: list[str], weights: list[list[float]], y: str) -> DataFrame:
    """Every row under every candidate. The candidates are a literal whose size does not depend on the data."""
    entries = ", ".join(
        f"struct({g} AS candidate, {', '.join(f'{number(x)} AS w{i}' for i, x in enumerate(w))})"
        for g, w in enumerate(weights)
    )
    return wide.selectExpr(
        f"{name(y)} AS y",
        *[f"{name(m)} AS b{i}" for i, m in enumerate(models)],
        f"inline(array({entries}))",
    )


def candidate_scores(
    wide: DataFrame, models: list[str], n_classes: int, weights: list[list[float]], y: str = "y"
) -> DataFrame:
    """Accuracy and F1 scores of each weight vector.

    Each row is scored under all candidates inside one code-generated stage and leaves its task only
    as counts per (candidate, class, predicted class).
    """
    sums = _weighted_classes(len(models), n_classes)
    names = [f"s{k}" for k in range(n_classes)]
    blends = _with_candidates(wide, models, weights, y).selectExpr(
        "candidate", "y", *[f"{e} AS {s}" for e, s in zip(sums, names)]
    )
    scored = blends.selectExpr("candidate", "y", f"{argmax_of(names)} AS y_pred")
    scores = summary_scores(confusion_counts(scored, ("candidate",)), ("candidate",))
    return _named_weights(scores, weights)


def _named_weights(scores: DataFrame, weights: list[list[float]]) -> DataFrame:
    table = array(array(number(x) for x in w) for w in weights)
    return scores.withColumn("weights", F.expr(f"element_at({table}, candidate + 1)"))


def candidate_auc(
    wide: DataFrame, models: list[str], n_classes: int, weights: list[list[float]], y: str = "y"
) -> DataFrame:
    """Exact support-weighted AUC of every candidate; NULL if the rows hold one class only.

    All rows are ordered under all candidates. For the best candidate alone, :func:`leading_candidates`
    first rules out the others.
    """
    scores = F.expr(array(_weighted_classes(len(models), n_classes)))
    pred = _with_candidates(wide, models, weights, y).select("candidate", "y", scores.alias("probs"))
    auc = mean_auc(auc_one_vs_rest(pred, ("candidate",)), ("candidate",))
    every = wide.sparkSession.range(len(weights)).selectExpr("cast(id AS int) AS candidate")
    return _named_weights(every.join(auc, "candidate", "left"), weights)


def leading_candidates(
    wide: DataFrame,
    models: list[str],
    n_classes: int,
    weights: list[list[float]],
    y: str = "y",
    bins: int = 256,
) -> list[int]:
    """Candidates that can have the highest AUC, by bounds; never without the best one.

    A histogram of scores bounds each AUC: pairs in different bins are decided, pairs in one bin count
    as lost or won. Candidates whose upper bound is below the best lower bound are ruled out.
    """
    exploded = _with_candidates(wide, models, weights, y)
    scores = F.expr(array(_weighted_classes(len(models), n_classes)))
    bars = (
        exploded.select("candidate", "y", F.posexplode(scores).alias("label", "score"))
        .groupBy("candidate", "label", F.expr(f"least(floor(score * {bins}), {bins - 1})").alias("bin"))
        .agg(
            F.expr("cast(count_if(y = label) AS double) AS pos"),
            F.expr("cast(count_if(y != label) AS double) AS neg"),
        )
    )
    earlier = (
        Window.partitionBy("candidate", "label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    bounds = (
        bars.withColumn("below", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
        .groupBy("candidate", "label")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.expr("sum(pos * below) AS lost"),
            F.expr("sum(pos * (below + neg)) AS won"),
        )
        .filter("pos > 0 AND neg > 0")
        .groupBy("candidate")
        .agg(
            F.expr("sum(lost / neg) / sum(pos) AS low"),
            F.expr("sum(won / neg) / sum(pos) AS high"),
        )
        .collect()
    )
    if not bounds:
        return list(range(len(weights)))
    reach = max(b.low for b in bounds) - 1e-12
    return sorted(b.candidate for b in bounds if b.high >= reach)


def best_weights(
    wide: DataFrame, models: list[str], n_classes: int, weights: list[list[float]], metric: str
) -> DataFrame:
    """``(candidate, weights, score)`` of the first candidate with the highest score."""
    if metric != "auc":
        return best_candidate(score_candidates(wide, models, n_classes, weights, metric))
    kept = leading_candidates(wide, models, n_classes, weights)
    best = best_candidate(score_candidates(wide, models, n_classes, [weights[g] for g in kept], "auc"))
    place = array(str(g) for g in kept)
    return best.withColumn("candidate", F.expr(f"element_at({place}, candidate + 1)"))


def score_candidates(
    wide: DataFrame, models: list[str], n_classes: int, weights: list[list[float]], metric: str
) -> DataFrame:
    """``(candidate, weights, score)`` under a metric given by name."""
    if metric not in METRIC_COLUMNS:
        raise ValueError(f"unknown metric: {metric}")
    table = (
        candidate_auc(wide, models, n_classes, weights)
        if metric == "auc"
        else candidate_scores(wide, models, n_classes, weights)
    )
    return table.select("candidate", "weights", F.col(METRIC_COLUMNS[metric]).alias("score"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The first candidate with the highest score."""
    return scores.agg(
        F.expr("min_by(struct(candidate, weights, score), struct(-score, candidate)) AS b")
    ).select("b.*")


def true_class_shares(wide: DataFrame, models: list[str], n_classes: int, y: str = "y") -> DataFrame:
    """Probability that each model gives the true class; all that likelihood steps need."""
    return wide.selectExpr(
        *[f"{at_class(name(m), name(y), n_classes)} AS q{i}" for i, m in enumerate(models)]
    )


def em_step(shares: DataFrame, weights: list[float]) -> DataFrame:
    """One expectation-maximisation step for mixture weights, with the mean log likelihood before it."""
    parts = [f"{number(w)} * q{i}" for i, w in enumerate(weights)]
    mix = total(parts)
    return shares.agg(
        *[F.expr(f"avg(try_divide({p}, {mix})) AS w{i}") for i, p in enumerate(parts)],
        F.expr(f"avg(if({mix} > 0, ln({mix}), NULL)) AS log_likelihood"),
    )


@dataclass(frozen=True)
class WeightedBlend:
    """Weighted soft voting over the array columns ``models`` of a wide prediction table.

    ``method`` is ``uniform``, ``grid_search`` (all weights in multiples of ``1 / steps``; their number grows with
    the models, so fewer steps suit many models), ``optimization`` or ``pattern_search``.

    ``optimization`` maximises the log likelihood by expectation-maximisation, since accuracy and F1 are piecewise constant in
    the weights and give a gradient nothing to follow; the requested metric is reported for the uniform and for the
    fitted weights.

    ``pattern_search`` maximises the requested metric itself. It starts at the best of the grid and the uniform weights and
    tries to move ``1 / steps`` of weight from each model to each other one, all trials in one job; if none is better,
    the step is halved, until it is below ``least_step``. So its score is never below those of the grid and of uniform weights.

    ``converged`` of the model is false if ``max_iter`` steps were not enough.
    """

    models: tuple[str, ...]
    n_classes: int
    method: str = "optimization"
    metric: str = "accuracy"
    use_proba: bool = True
    max_iter: int = 100
    tol: float = 1e-7
    steps: int = GRID_STEPS
    least_step: float = 1 / 256

    def __post_init__(self) -> None:
        if not self.use_proba:
            raise NotImplementedError("hard voting is not available: use_proba=True is required")
        if self.method not in ("uniform", "grid_search", "optimization", "pattern_search"):
            raise ValueError(f"unknown method: {self.method}")
        if self.metric not in METRIC_COLUMNS:
            raise ValueError(f"unknown metric: {self.metric}")
        if not self.models:
            raise ValueError("at least one model is needed")

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> WeightedBlendModel:
        """Fit on ``valid`` if given, else on ``train``."""
        wide = train if valid is None else valid
        models = list(self.models)
        uniform = [1.0 / len(models)] * len(models)
        if self.method == "uniform" or len(models) == 1:
            return WeightedBlendModel(self, tuple(uniform))
        if self.method == "grid_search":
            grid = simplex_grid(len(models), self.steps)
            best = best_weights(wide, models, self.n_classes, grid, self.metric).first()
            return WeightedBlendModel(self, tuple(normalise_weights(best.weights)), None, best.score)
        if self.method == "pattern_search":
            return self._search(wide, models, uniform)
        weights, converged = self._maximise_likelihood(wide, uniform)
        scores = {
            r.candidate: r.score
            for r in self._both_scores(wide, models, [uniform, weights])
        }
        return WeightedBlendModel(self, tuple(weights), scores.get(0), scores.get(1), converged)

    def _search(self, wide: DataFrame, models: list[str], uniform: list[float]) -> WeightedBlendModel:
        """Moves of weight between two models at a time; of equal trials the first counts, and only a better one is taken."""
        columns = list(dict.fromkeys([*models, "y"]))
        with cached(wide.select(*[F.col(name(c)) for c in columns])) as rows:

            def best_of(trials: list[list[float]]) -> tuple[float, list[float]]:
                found = best_weights(rows, models, self.n_classes, trials, self.metric).first()
                return (-math.inf if found.score is None else found.score), trials[found.candidate]

            start = best_of([uniform])[0]
            score, weights = max((start, uniform), best_of(simplex_grid(len(models), self.steps)), key=lambda x: x[0])
            step, converged = 1.0 / self.steps, False
            for _ in range(self.max_iter):
                if step < self.least_step:
                    converged = True
                    break
                trials = _moves(weights, step)
                now, there = best_of(trials)
                if now > score:
                    score, weights = now, there
                else:
                    step /= 2
        return WeightedBlendModel(self, tuple(weights), start, score, converged)

    def _both_scores(self, wide: DataFrame, models: list[str], weights: list[list[float]]) -> list:
        if self.metric != "auc":
            return score_candidates(wide, models, self.n_classes, weights, self.metric).collect()
        pred = _with_candidates(wide, models, weights, "y").select(
            "candidate", "y", F.expr(array(_weighted_classes(len(models), self.n_classes))).alias("probs")
        )
        return (
            mean_auc(auc_one_vs_rest(pred, ("candidate",)), ("candidate",))
            .withColumnRenamed("auc", "score")
            .collect()
        )

    def _maximise_likelihood(self, wide: DataFrame, start: list[float]) -> tuple[list[float], bool]:
        weights = start
        with cached(true_class_shares(wide, list(self.models), self.n_classes)) as shares:
            for _ in range(self.max_iter):
                row = em_step(shares, weights).first()
                if row.w0 is None:
                    return start, False
                stepped = normalise_weights([row[f"w{i}"] for i in range(len(weights))])
                moved = max(abs(a - b) for a, b in zip(stepped, weights))
                weights = stepped
                if moved < self.tol:
                    return weights, True
        return weights, False


def _moves(weights: list[float], step: float) -> list[list[float]]:
    """All moves of ``step``, or of what is there, from one weight to another."""
    out = []
    for i in range(len(weights)):
        for j in range(len(weights)):
            if i != j and weights[i] > 0:
                moved = list(weights)
                part = min(step, moved[i])
                moved[i] -= part
                moved[j] += part
                out.append(moved)
    return out


@dataclass(frozen=True)
class WeightedBlendModel:
    blend: WeightedBlend
    weights: tuple[float, ...]
    uniform_score: float | None = None
    fitted_score: float | None = None
    converged: bool = True

    def transform(self, wide: DataFrame) -> DataFrame:
        """Add ``probs`` and ``y_pred``."""
        models = list(self.blend.models)
        return wide.withColumn(
            "probs", blended(models, list(self.weights), self.blend.n_classes)
        ).withColumn("y_pred", F.expr(argmax("probs")))

    def score(self, wide: DataFrame, y: str = "y") -> float:
        """Accuracy."""
        return self.transform(wide).agg(F.avg((F.col(y) == F.col("y_pred")).cast("int"))).first()[0]

    def get_weights(self) -> dict[str, float]:
        return dict(zip(self.blend.models, self.weights))

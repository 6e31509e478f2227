"""Stacking with MLlib estimators, their base learners and hyper-parameter search."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Row, functions as F

from gradeloom.functions.probability import argmax, checked_width, normalised
from gradeloom.functions.text import array, name as quoted
from gradeloom.operators.blocks import scatter_folds
from gradeloom.operators.forest import RandomForest
from gradeloom.operators.class_weights import class_weights, weight_column, weight_list
from gradeloom.operators.meta_features import MetaLayout
from gradeloom.operators.learners import feature_array
from gradeloom.operators.logistic import MetaRegression
from gradeloom.operators.metrics import confusion_counts, summary_scores
from gradeloom.operators.network import NetworkModel
from gradeloom.operators.tree_stages import TreesPerClass
from gradeloom.sources.predictions import require_meta_dim
from gradeloom.sources.shared import cached, materialize

# Hidden layers of the three network meta-learners.
HIDDEN_LAYERS = {"wide": (64, 32), "single": (32,), "narrow": (48, 24)}

# Search grid of the forest. MLlib caps the depth at 30, the grid's 35 is out of range;
# it has no minimum per split (10, 15).
FOREST_GRID = {
    "numTrees": (200, 300),
    "maxDepth": (25, 30),
    "minInstancesPerNode": (4, 6),
}

# Search grids of the two boosted-tree learners. `boosted_trees` has no L2 penalty per leaf (1, 5).
DEEP_BOOSTED_GRID = {
    "maxIter": (100, 200),
    "maxDepth": (5, 10),
    "stepSize": (0.01, 0.1),
    "subsamplingRate": (0.7, 1.0),
    "featureSubsetStrategy": ("0.7", "all"),
}
SHALLOW_BOOSTED_GRID = {
    "maxIter": (100, 200),
    "maxDepth": (4, 6),
    "stepSize": (0.01, 0.1),
    "subsamplingRate": (0.7, 1.0),
}


def to_vector(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Feature vector from numeric columns."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.withColumn(output, array_to_vector(values))


def random_forest(features: str = "features", label: str = "y", seed: int = 42, **params) -> RandomForest:
    """Forest with square-root feature sampling; it has a minimum per leaf but none per split."""
    settings = {"featureSubsetStrategy": "sqrt", "seed": seed} | params
    return RandomForest(featuresCol=features, labelCol=label, **settings)


def boosted_trees(features: str = "features", label: str = "y", seed: int = 42, **params) -> TreesPerClass:
    """Gradient-boosted trees of each class against the others; classes compete by margin."""
    return TreesPerClass(featuresCol=features, labelCol=label, seed=seed, **params)


def logistic_meta(
    n_rows: int, c: float = 1.0, features: str = "features", label: str = "y", weight: str | None = None
) -> LogisticRegression:
    """Multinomial logistic regression with an L2 penalty of inverse strength ``c``."""
    lr = MetaRegression(
        featuresCol=features,
        labelCol=label,
        family="multinomial",
        regParam=1.0 / (c * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=2000,
        tol=1e-4,
    )
    return lr.setWeightCol(weight) if weight else lr


def network_meta(
    n_inputs: int,
    n_classes: int,
    hidden: tuple[int, ...] = HIDDEN_LAYERS["wide"],
    features: str = "features",
    label: str = "y",
    seed: int = 42,
    max_iter: int = 300,
) -> MultilayerPerceptronClassifier:
    """Feed-forward network with sigmoid hidden units; MLlib has no other kind, nor early stopping."""
    return MultilayerPerceptronClassifier(
        featuresCol=features,
        labelCol=label,
        layers=[n_inputs, *hidden, n_classes],
        seed=seed,
        maxIter=max_iter,
    )


def score_blocks(df: DataFrame, models: dict[str, Model], n_classes: int) -> DataFrame:
    """Add a probability array per fitted model; one pass, no join.

    Models without a probability column (one-vs-rest) give their raw scores through a logistic,
    normalised over the classes.
    """
    for model_name, model in models.items():
        columns = df.columns
        scored = model.transform(df)
        if "probability" in scored.columns:
            probs = feature_array(scored, "probability")
        else:
            raw = vector_to_array("rawPrediction")
            odds = array(f"1.0D / (1.0D + exp(-2.0D * _raw[{k}]))" for k in range(n_classes))
            scored = scored.withColumn("_raw", raw).withColumn("_odds", F.expr(odds))
            probs = F.expr(normalised("_odds", n_classes))
        df = scored.select(*[F.col(quoted(c)) for c in columns], probs.alias(model_name)).withColumn(
            model_name, F.expr(checked_width(quoted(model_name), n_classes))
        )
    return df


def fit_side_by_side(jobs: list[tuple[Estimator, DataFrame]], parallelism: int) -> list[Model]:
    """Fit independent models from several driver threads, so that their stages share the cluster."""
    if not jobs:
        return []

    @inheritable_thread_target(jobs[0][1].sparkSession)
    def fit(job: tuple[Estimator, DataFrame]) -> Model:
        return job[0].fit(job[1])

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(fit, jobs))


def fit_all(df: DataFrame, estimators: dict[str, Estimator], parallelism: int = 4) -> dict[str, Model]:
    models = fit_side_by_side([(e, df) for e in estimators.values()], parallelism)
    return dict(zip(estimators, models))


def out_of_fold(
    df: DataFrame,
    estimators: dict[str, Estimator],
    n_classes: int,
    k: int,
    fold: str = "fold",
    parallelism: int = 4,
) -> DataFrame:
    """Wide table in which every row is scored by models fitted on the other folds."""
    jobs = [(e, df.filter(F.col(fold) != f)) for f in range(k) for e in estimators.values()]
    models = iter(fit_side_by_side(jobs, parallelism))
    return scatter_folds(
        [
            score_blocks(df.filter(F.col(fold) == f), {m: next(models) for m in estimators}, n_classes)
            for f in range(k)
        ]
    )


@dataclass(frozen=True)
class StackingEnsemble:
    """Base estimators, their out-of-fold probabilities and a logistic meta-learner on top.

    The input has ``row_id``, the target, a ``fold`` column and the estimators' feature column.
    ``enhanced`` adds confidence figures to the probabilities. ``stored`` names models that only
    have stored out-of-fold blocks; they are array columns of the input already and are never
    replaced by in-sample scores.
    """

    base: dict[str, Estimator]
    n_classes: int
    n_folds: int = 5
    c: float = 1.0
    balanced: bool = False
    enhanced: bool = False
    stored: tuple[str, ...] = ()
    target: str = "y"
    fold: str = "fold"
    meta: Estimator | None = None
    parallelism: int = 4

    def _layout(self) -> MetaLayout:
        names = tuple(self.base)
        if self.enhanced:
            return MetaLayout(names, self.n_classes, raw=self.stored)
        return MetaLayout((), self.n_classes, raw=names + self.stored)

    def fit(self, df: DataFrame) -> StackingModel:
        return self.fit_metas(df, {"meta": self.meta})["meta"]

    def fit_metas(self, df: DataFrame, metas: dict[str, Estimator | None]) -> dict[str, StackingModel]:
        """Stacks with several meta-learners on top of the same base models and out-of-fold blocks.

        None stands for the logistic meta-learner of this ensemble.
        """
        layout = self._layout()
        missing = [m for m in self.stored if m not in df.columns]
        if missing:
            raise ValueError(f"no out-of-fold blocks for models {missing}")
        if len(layout.models) < 2:
            raise ValueError("at least two base models are needed for stacking")
        with cached(df) as rows:
            oof = out_of_fold(
                rows, self.base, self.n_classes, self.n_folds, self.fold, self.parallelism
            )
            train = materialize(
                layout.assemble(oof, "_meta").select(self.target, array_to_vector("_meta").alias("_meta")),
                "meta",
            )
            base_models = fit_all(rows, self.base, self.parallelism)
        return {
            name: StackingModel(replace(self, meta=meta), layout, base_models, self._fit_meta(train, meta))
            for name, meta in metas.items()
        }

    def _fit_meta(self, train: DataFrame, meta: Estimator | None) -> Model:
        if meta is not None:
            return meta.fit(train)
        n_rows = train.count()
        if self.balanced:
            weights = weight_list(class_weights(train, self.target, self.n_classes), "balanced")
            train = train.withColumn("_weight", weight_column(self.target, weights))
        weight = "_weight" if self.balanced else None
        return logistic_meta(n_rows, self.c, "_meta", self.target, weight).fit(train)


@dataclass(frozen=True)
class StackingModel:
    ensemble: StackingEnsemble
    layout: MetaLayout
    base_models: dict[str, Model] = field(repr=False)
    meta_model: Model = field(repr=False)

    def predict_blocks(self, wide: DataFrame) -> DataFrame:
        """Add ``probs`` and ``y_pred`` to a table that holds the blocks of all base models.

        Raises if the layout does not fit the meta-learner, as after loading parts of different models.
        """
        require_meta_dim(len(self.layout.slot_names()), Row(meta_dim=self.meta_model.numFeatures))
        columns = wide.columns
        features = self.layout.assemble(wide, "_meta").withColumn("_meta", array_to_vector("_meta"))
        scored = self.meta_model.transform(features)
        return scored.select(
            *[F.col(f"`{c}`") for c in columns], vector_to_array("probability").alias("probs")
        ).withColumn("y_pred", F.expr(argmax("probs")))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict_blocks(score_blocks(df, self.base_models, self.ensemble.n_classes))

    def coefficients(self, df: DataFrame) -> DataFrame:
        """``(output, slot, coef)`` of the meta-learner, a table of fixed small size.

        For a network these are the weights of its first layer.
        """
        spark = df.sparkSession
        if hasattr(self.meta_model, "coefficientMatrix"):
            matrix = self.meta_model.coefficientMatrix.toArray()
        elif isinstance(self.meta_model, NetworkModel):
            matrix = self.meta_model.layers[0][:-1].T
        else:
            n_in, n_out = self.meta_model.getLayers()[:2]
            flat = self.meta_model.weights.toArray()[: n_in * n_out]
            matrix = flat.reshape(n_in, n_out).T
        cells = [
            (o, s, float(v)) for o, row in enumerate(matrix) for s, v in enumerate(row)
        ]
        return spark.createDataFrame(cells, "output int, slot int, coef double")

    def get_model_weights(self, df: DataFrame) -> dict[str, float]:
        """Share of the absolute meta-learner weights that falls on each base model."""
        from gradeloom.operators.diagnose import usage_share

        return {r.model: r.share for r in usage_share(self.coefficients(df), self.layout).collect()}

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Accuracy, macro and weighted F1."""
        return summary_scores(confusion_counts(self.transform(df), y=self.ensemble.target))


def parameter_grid(estimator: Estimator, values: dict[str, tuple]) -> list[dict]:
    """All settings of ``values``; those of a one-vs-rest estimator belong to its inner classifier."""
    owner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    builder = ParamGridBuilder()
    for param, options in values.items():
        builder = builder.addGrid(owner.getParam(param), list(options))
    return builder.build()


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: list[dict],
    k: int = 5,
    fold: str = "fold",
    label: str = "y",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validated accuracy over a grid with given folds; the best setting is refitted on all rows."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
    ).fit(df)


def grid_table(df: DataFrame, search: CrossValidatorModel) -> DataFrame:
    """Mean accuracy per setting of a grid search; ``best`` marks the first best one."""
    top = max(range(len(search.avgMetrics)), key=lambda i: (search.avgMetrics[i], -i))
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(s.items(), key=lambda x: x[0].name)), float(a), i == top)
        for i, (s, a) in enumerate(zip(search.getEstimatorParamMaps(), search.avgMetrics))
    ]
    return df.sparkSession.createDataFrame(
        rows, "setting int, parameters string, accuracy double, best boolean"
    )


def split_scores(df: DataFrame, model: Model, label: str = "y") -> DataFrame:
    """Accuracy of a fitted model on each part of a table with a ``split`` column."""
    hit = (F.col("prediction") == F.col(label)).cast("double")
    return model.transform(df).groupBy("split").agg(F.avg(hit).alias("accuracy"))

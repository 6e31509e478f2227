"""Queries of the library's own learners: boosted trees, categories as inputs, networks. They join the other queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.ground_motion import pga_g
from gradeloom.functions.text import total
from gradeloom.operators import boost, metrics, network, stack
from gradeloom.operators.boosted import SoftmaxBoostedTrees
from gradeloom.operators.encode import LabelEncoder
from gradeloom.operators.impute import Imputer
from gradeloom.operators.meta_features import MetaLayout
from gradeloom.operators.scoring import score_with_file, write_arrays
from gradeloom.operators.split import holdout_split
from gradeloom.operators.target_statistics import OrderedTargetStatistics
from gradeloom.plans import inputs as I
from gradeloom.plans import survey
from gradeloom.plans.queries import C, KM, M, QUERIES, ml_rows, query, rounded, spread, stored_again, _report, _train
from gradeloom.sources.shared import materialize, new_table_path
from gradeloom.spec import SURVEY_FEATURES

__all__ = ["QUERIES"]

#: Small inputs of the enumerable learners, as SQL that both engines read alike.
FEW_VALUES = {
    "floors": "cast(count_floors_pre_eq AS double)",
    "ground": "cast(ground_floor_type AS double)",
    "age": "cast(floor(age_building / 10) AS double)",
    "flags": f"cast({total(SURVEY_FEATURES.flags)} AS double)",
}


def few_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with inputs of few values, some of them missing."""
    rows = I.labelled(spark, sf_dir)
    features = F.array(*[F.expr(e) for e in FEW_VALUES.values()])
    return rows.select("row_id", "y", features.alias("features"))


def _probabilities(scored: DataFrame, keep: list[str]) -> DataFrame:
    probs = scored.select(*keep, vector_to_array("probability").alias("probs"))
    return spread(probs, "probs", "p")


# ---------------------------------------------------------------- boosted trees

#: One round of trees that can be enumerated.
ONE_ROUND = {"maxIter": 1, "maxDepth": 2, "stepSize": 0.3, "leafPenalty": 1.0}


@query
def boosted_one_round(spark, sf_dir):
    """Class probabilities after one round of trees of two levels, with missing values."""
    rows = few_values(spark, sf_dir)
    model = SoftmaxBoostedTrees(numClasses=C, **ONE_ROUND).fit(rows)
    return _probabilities(model.transform(rows), ["row_id", "y"])


@query
def boosted_search(spark, sf_dir):
    """Cross-validated accuracy of trees of one and two levels on given folds."""
    folds = I.folded(spark, sf_dir).select("row_id", "fold")
    rows = materialize(few_values(spark, sf_dir).join(folds, "row_id"), "folds")
    trees = SoftmaxBoostedTrees(numClasses=C, **ONE_ROUND)
    search = stack.grid_search(rows, trees, stack.parameter_grid(trees, {"maxDepth": (1, 2)}), k=5)
    return rounded(stack.grid_table(rows, search), "accuracy")


#: Settings from the declared grids, as the other boosted learners have them; the first library's penalty is its default.
DEEP = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.7, "featureShare": 0.7, "leafPenalty": 1.0}
SHALLOW = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.7, "leafPenalty": 1.0}


@query
def boosted_softmax(spark, sf_dir):
    """A hundred rounds of trees of five levels on the softmax loss, with row and column sampling."""
    rows = ml_rows(spark, sf_dir)
    model = SoftmaxBoostedTrees(numClasses=C, rowCol="row_id", **DEEP).fit(_train(rows))
    return _report(model.transform(rows).withColumn("y_pred", F.col("prediction").cast("int")))


CATEGORIES = ("foundation_type", "roof_type", "ground_floor_type")
#: With it, shares seldom end in a 5 at the digit where results are rounded.
STRENGTH = 1.7


@query
def ordered_statistics(spark, sf_dir):
    """Class shares of three categories, each row from the rows before it in a seeded order."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", *CATEGORIES)
    _, out = OrderedTargetStatistics(CATEGORIES, C, strength=STRENGTH).fit_transform(rows)
    names = [f"{c}_shares" for c in CATEGORIES]
    return spread(out.select("row_id", "y", *names), names, [f"{c}_p" for c in CATEGORIES])


@query
def target_statistics(spark, sf_dir):
    """Class shares of the categories of test rows, from all training rows."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", *CATEGORIES)
    split = materialize(holdout_split(rows, "row_id", "y", 0.3, 0.0), "split")
    model = OrderedTargetStatistics(CATEGORIES, C, strength=STRENGTH).fit(split.where("split <> 'test'"))
    names = [f"{c}_shares" for c in CATEGORIES]
    out = model.transform(split.where("split = 'test'")).select("row_id", "y", *names)
    return spread(out, names, [f"{c}_p" for c in CATEGORIES])


@query
def boosted_categories(spark, sf_dir):
    """Boosted trees on numbers and on ordered statistics of the categories."""
    rows = ml_rows(spark, sf_dir)
    rows = rows.join(I.labelled(spark, sf_dir).select("row_id", *CATEGORIES), "row_id")
    model, train = OrderedTargetStatistics(CATEGORIES, C).fit_transform(materialize(_train(rows), "train"))
    test = model.transform(rows.where("split = 'test'"))
    both = train.unionByName(test)
    parts = ["vector_to_array", *[f"{c}_shares" for c in CATEGORIES]]
    both = both.withColumn(parts[0], vector_to_array("features")).withColumn("features", F.concat(*parts))
    both = materialize(both.select("row_id", "y", "split", "features"), "categories")
    trees = SoftmaxBoostedTrees(numClasses=C, rowCol="row_id", **SHALLOW).fit(_train(both))
    return _report(trees.transform(both).withColumn("y_pred", F.col("prediction").cast("int")))


# ---------------------------------------------------------------- enumerable trees of MLlib


@query
def forest_of_stumps(spark, sf_dir):
    """A forest of one tree with one split on all rows and features: class shares on both sides."""
    rows = few_values(spark, sf_dir).withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(-1.0))))
    rows = materialize(rows.withColumn("features", array_to_vector("features")), "stumps")
    tree = RandomForestClassifier(
        labelCol="y", numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False, maxBins=64, seed=42
    )
    return _probabilities(tree.fit(rows).transform(rows), ["row_id", "y"])


@query
def regression_stumps(spark, sf_dir):
    """Two stages of boosting, each with a regression tree of one split per class."""
    rows = few_values(spark, sf_dir).withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(-1.0))))
    rows = rows.withColumn("features", array_to_vector("features")).withColumn("split", F.lit("train"))
    rows = materialize(rows, "stumps")
    stump = boost.RegressorPerClass(DecisionTreeRegressor(featuresCol="features", maxDepth=1, maxBins=64, seed=42))
    model = boost.Booster((stump, stump), C, (0.5, 0.5)).fit(rows)
    return spread(model.transform(rows).select("row_id", "y", "scores"), "scores", "s")


# ---------------------------------------------------------------- networks

#: Units, penalty and layers of the three meta-learners; fixed values.
NETWORKS = {
    "wide": {"hidden": stack.HIDDEN_LAYERS["wide"], "activation": "relu", "l2": 1e-4},
    "single": {"hidden": stack.HIDDEN_LAYERS["single"], "activation": "relu", "l2": 1e-4},
    "narrow": {"hidden": stack.HIDDEN_LAYERS["narrow"], "activation": "tanh", "l2": 5e-4},
}


def plain_weights(sizes: list[int]) -> list[list[list[float]]]:
    """Weights by a rule, to be written out in SQL: layer, input (the bias last), output."""
    return [
        [[((i * 7 + j * 13 + layer * 5) % 11 - 5) / 10 for j in range(b)] for i in range(a + 1)]
        for layer, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]))
    ]


def _plain_network(n_inputs: int, shape: str) -> network.NetworkModel:
    sizes = [n_inputs, *NETWORKS[shape]["hidden"], C]
    flat = np.concatenate([np.array(w, float).ravel() for w in plain_weights(sizes)])
    unit = sorted(network._APPLY).index(NETWORKS[shape]["activation"])
    arrays = {"weights": flat, "sizes": np.array(sizes, np.int64), "activation": np.array([unit], np.int64)}
    return network.NetworkModel({**arrays, "history": np.zeros((0, 2))})


def _blocks_as_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.signal_predictions(spark, sf_dir).select("row_id", "y", F.concat(*M).alias("features"))


@query
def network_forward(spark, sf_dir):
    """Probabilities of the three network shapes under weights given by a rule."""
    rows = _blocks_as_features(spark, sf_dir)
    out = None
    for shape in NETWORKS:
        scored = _plain_network(len(M) * C, shape).transform(rows).withColumn("shape", F.lit(shape))
        part = _probabilities(scored, ["row_id", "y", "shape"])
        out = part if out is None else out.unionByName(part)
    return out


@query
def score_network_file(spark, sf_dir):
    """A network whose arrays lie in one file with a checksum, scored on the executors in chunks of 128 rows."""
    rows = _blocks_as_features(spark, sf_dir)
    columns = [f"x{k}" for k in range(len(M) * C)]
    rows = rows.select("row_id", "y", *[F.col("features")[k].alias(c) for k, c in enumerate(columns)])
    model = _plain_network(len(M) * C, "narrow")
    path = f"{new_table_path(spark, 'network')}.npz"
    checksum = write_arrays(spark, model.arrays, path)
    scored = score_with_file(
        rows, path, checksum, lambda arrays: network.NetworkModel(arrays).scorer(), ["row_id", "y"], columns, "probs", 128
    )
    return spread(scored, "probs", "p")


@query
def network_gradient(spark, sf_dir):
    """Mean loss of the three shapes under these weights, and the slope of each class's bias, as a training step sums them."""
    rows = materialize(_blocks_as_features(spark, sf_dir).selectExpr("features", "y", "1.0D AS weight", "0 AS batch"), "network")
    out = []
    for shape in NETWORKS:
        model = _plain_network(len(M) * C, shape)
        sums = network._sums(rows, model.arrays["weights"], model.sizes, model.activation, 0, rows.rdd.getNumPartitions())
        out.append((shape, *[float(v) for v in (sums[0] / sums[1], *(sums[-C:] / sums[1]))]))
    names = ["loss", *[f"g{k}" for k in range(C)]]
    return rounded(spark.createDataFrame(out, "shape string, " + ", ".join(f"{n} double" for n in names)), *names)


@query
def network_meta_learners(spark, sf_dir):
    """The three meta-learners trained on out-of-fold frequencies with confidence figures: scores of the test rows."""
    rows = ml_rows(spark, sf_dir)
    wide = I.signal_predictions(spark, sf_dir)
    features = MetaLayout(tuple(M), C).assemble(wide, "meta").select("row_id", "meta")
    rows = materialize(rows.select("row_id", "y", "split").join(features, "row_id"), "meta")
    out = None
    for shape, settings in NETWORKS.items():
        learner = network.NetworkClassifier(featuresCol="meta", numClasses=C, **settings)
        scored = learner.fit(_train(rows)).transform(rows).withColumn("y_pred", F.col("prediction").cast("int"))
        report = _report(scored).withColumn("shape", F.lit(shape))
        out = report if out is None else out.unionByName(report)
    return out


@query
def stack_networks(spark, sf_dir):
    """Stacks with each of the three network meta-learners on top of the same out-of-fold blocks."""
    rows = ml_rows(spark, sf_dir)
    train = _train(rows)
    bases = {
        "trees": SoftmaxBoostedTrees(numClasses=C, rowCol="row_id", **SHALLOW | {"maxIter": 20}),
        "logistic": stack.logistic_meta(train.count()),
    }
    out = None
    for shape, model in stack.StackingEnsemble(bases, C, 5, enhanced=True).fit_metas(
        train, {s: network.NetworkClassifier(featuresCol="_meta", numClasses=C, **v) for s, v in NETWORKS.items()}
    ).items():
        report = _report(model.transform(rows)).withColumn("shape", F.lit(shape))
        out = report if out is None else out.unionByName(report)
    return out


@query
def transfer_stack(spark, sf_dir):
    """A stack with its preparation, fitted on the home survey, stored and read again, on home test rows and the foreign survey."""
    home = I.labelled(spark, sf_dir).select(
        "row_id", "y", F.col("count_floors_pre_eq").cast("double").alias("floors"), F.col("ground_floor_type").cast("string").alias("ground"),
        F.col("has_superstructure_rc_engineered").cast("double").alias("engineered"), F.coalesce(pga_g(KM), F.lit(0.0)).alias("pga"),
    )
    home = materialize(holdout_split(home, "row_id", "y", 0.3, folds=5), "home")
    away = survey.shape_foreign(I.foreign_survey(spark, sf_dir)).select(
        F.monotonically_increasing_id().alias("row_id"), F.col("damage_grade").alias("y"),
        F.col("count_floors_pre_eq").cast("double").alias("floors"), F.col("ground_floor_type").cast("string").alias("ground"),
        F.col("has_superstructure_rc_engineered").cast("double").alias("engineered"), F.col("PGA_g").cast("double").alias("pga"),
    )
    train = home.where("split <> 'test'")
    imputer, encoder = Imputer(("floors",)).fit(train), LabelEncoder(("ground",)).fit(train)

    def prepared(rows: DataFrame, parts: dict) -> DataFrame:
        rows = parts["encoder"].transform(parts["imputer"].transform(rows))
        return stack.to_vector(rows, ["floors", "ground", "engineered", "pga"])

    parts = {"imputer": imputer, "encoder": encoder}
    rows = materialize(prepared(train, parts), "prepared")
    bases = {
        "trees": SoftmaxBoostedTrees(numClasses=C, rowCol="row_id", maxIter=5, maxDepth=3),
        "logistic": stack.logistic_meta(rows.count()),
    }
    parts = stored_again(spark, parts | {"stack": stack.StackingEnsemble(bases, C, 5, enhanced=True).fit(rows)})
    both = home.where("split = 'test'").select("row_id", "y", "floors", "ground", "engineered", "pga", F.lit("home").alias("domain"))
    both = both.unionByName(away.withColumn("domain", F.lit("foreign")))
    scored = parts["stack"].transform(prepared(both, parts))
    report = metrics.model_report(scored.withColumn("model", F.lit("stack")), C, ("domain", "model"))
    return rounded(report, "accuracy", "f1_macro", "f1_weighted", "log_loss")


@query
def logistic_gradient(spark, sf_dir):
    """Slope of the penalised loss of the logistic meta-learner at its fitted coefficients: zero everywhere."""
    wide = I.signal_predictions(spark, sf_dir)
    layout = MetaLayout(tuple(M), C)
    rows = layout.assemble(wide, "meta").select("row_id", "y", "meta")
    rows = materialize(rows.withColumn("features", array_to_vector("meta")), "meta")
    n = rows.count()
    model = stack.logistic_meta(n, 0.2).setTol(1e-10).fit(rows)
    probs = model.transform(rows).select("y", "meta", vector_to_array("probability").alias("p"))
    slots = len(layout.slot_names())
    sums = ", ".join(f"avg((p[{k}] - int(y = {k})) * meta[{s}])" for k in range(C) for s in range(slots))
    slopes = np.array(probs.selectExpr(f"array({sums}) AS g").first().g).reshape(C, slots)
    slopes += model.coefficientMatrix.toArray() / (0.2 * n)
    cells = [(k, s, float(v)) for k, row in enumerate(slopes) for s, v in enumerate(row)]
    return rounded(spark.createDataFrame(cells, "label int, slot int, slope double"), "slope", digits=4)

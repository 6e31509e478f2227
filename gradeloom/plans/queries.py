"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gradeloom.functions import probability as P
from gradeloom.functions import survey as S
from gradeloom.functions.ground_motion import pga_g
from gradeloom.functions.text import array, name, total
from gradeloom.operators import blend as B
from gradeloom.operators import blocks, boost, calibrate, class_weights, diagnose, metrics, stack
from gradeloom.operators.encode import LabelEncoder
from gradeloom.operators.frequency import FrequencyLearner
from gradeloom.operators.impute import (
    Imputer,
    describe_columns,
    drop_unlabelled,
    fit_impute,
    fit_scaler,
)
from gradeloom.operators.isotonic import CrossCalibration
from gradeloom.operators.meta_features import MetaLayout
from gradeloom.operators.scoring import score_in_batches
from gradeloom.operators.split import (
    holdout_split,
    stratified_folds,
    train_and_valid,
    union_splits,
)
from gradeloom.plans import inputs as I
from gradeloom.plans import survey
from gradeloom.sources import predictions as stored
from gradeloom.sources import tables
from gradeloom.sources.models import load_model, save_model
from gradeloom.sources.shared import materialize, new_table_path
from gradeloom.spec import FOREIGN_CONSTANTS, GRADE_NAMES, KM_PER_MILE, SURVEY_FEATURES

C = I.N_CLASSES
M = I.SIGNAL_MODELS
DIGITS = 8
KM = f"distance_mi * {KM_PER_MILE}D"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round only at the very end; adding 0.0 turns a negative zero into zero."""
    return df.selectExpr(
        *[f"round({name(c)}, {digits}) + 0.0D AS {name(c)}" if c in columns else name(c) for c in df.columns]
    )


def spread(df: DataFrame, arrays: str | list[str], prefixes: str | list[str], n: int = C) -> DataFrame:
    """Array columns to rounded scalar columns."""
    arrays = [arrays] if isinstance(arrays, str) else arrays
    prefixes = [prefixes] if isinstance(prefixes, str) else prefixes
    return df.selectExpr(
        *[name(c) for c in df.columns if c not in arrays],
        *[
            f"round({name(a)}[{k}], {DIGITS}) + 0.0D AS {p}{k}"
            for a, p in zip(arrays, prefixes)
            for k in range(n)
        ],
    )


# ---------------------------------------------------------------- sources and sinks

LOCALE_SCHEMA = StructType(
    [
        StructField("building_id", LongType()),
        StructField("distance_mi", DoubleType()),
        StructField("roof_type", StringType()),
        StructField("damage_grade", IntegerType()),
    ]
)


@query
def scan_locale_csv(spark, sf_dir):
    """Write the survey with decimal commas and read it back."""
    path = new_table_path(spark, "locale-csv")
    tables.write_locale_csv(I.buildings(spark, sf_dir).select(LOCALE_SCHEMA.names), path)
    return tables.read_locale_csv(spark, path, LOCALE_SCHEMA)


@query
def scan_csv_skipping_lines(spark, sf_dir):
    """A title line and a units line around the header of every part file are no data."""
    path = new_table_path(spark, "titled-csv")
    rows = I.buildings(spark, sf_dir).select(LOCALE_SCHEMA.names)
    lines = rows.select(
        F.concat_ws(
            ";",
            F.col("building_id").cast("string"),
            F.coalesce(F.replace(F.col("distance_mi").cast("string"), F.lit("."), F.lit(",")), F.lit("")),
            F.coalesce("roof_type", F.lit("")),
            F.col("damage_grade").cast("string"),
        ).alias("value")
    )
    preamble = "Survey of buildings\n" + ";".join(LOCALE_SCHEMA.names) + "\n-;miles;-;grade"
    # The first row of every partition carries the preamble, so every part file opens with it.
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    lines.withColumn(
        "value", F.when(first, F.concat(F.lit(preamble + "\n"), F.col("value"))).otherwise(F.col("value"))
    ).write.text(path)
    return tables.read_csv_skipping_lines(spark, path, LOCALE_SCHEMA, skip_lines=(0, 2))


@query
def csv_round_trip(spark, sf_dir):
    path = new_table_path(spark, "csv")
    tables.write_csv(I.buildings(spark, sf_dir).select(LOCALE_SCHEMA.names), path)
    return tables.read_csv(spark, path, LOCALE_SCHEMA)


@query
def prediction_store(spark, sf_dir):
    """Store predictions of three models, then load two of them strictly."""
    wide = I.signal_predictions(spark, sf_dir)
    path = new_table_path(spark, "predictions")
    stored.write_predictions(blocks.long_blocks(wide, M), path)
    pred = stored.read_predictions(spark, path, ["m0", "m2"], I.labelled(spark, sf_dir))
    return spread(pred.select("row_id", "y", "model", "probs"), "probs", "p")


@query
def prediction_store_in_turn(spark, sf_dir):
    """Three models stored by two jobs, then one of them stored again: the others stay, the later one counts."""
    wide = I.signal_predictions(spark, sf_dir)
    path = new_table_path(spark, "predictions")
    stored.write_predictions(blocks.long_blocks(wide, ["m0", "m1"]), path)
    stored.write_predictions(blocks.long_blocks(wide, ["m2"]), path)
    stored.write_predictions(blocks.long_blocks(wide.withColumn("m1", F.col("m0")), ["m1"]), path)
    pred = stored.read_predictions(spark, path, M, I.labelled(spark, sf_dir))
    return spread(pred.select("row_id", "y", "model", "probs"), "probs", "p")


@query
def metrics_json(spark, sf_dir):
    """Store a metric table as JSON and read it back."""
    path = new_table_path(spark, "metrics")
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    stored.write_metrics(metrics.model_report(pred, C), path)
    back = spark.read.schema("model string, accuracy double, f1_macro double, n long").json(path)
    return rounded(back, "accuracy", "f1_macro")


# ---------------------------------------------------------------- preparation


@query
def prep_pga(spark, sf_dir):
    rows = I.buildings(spark, sf_dir).select(
        "building_id", S.miles_to_km(F.col("distance_mi")).alias("distance_km")
    )
    return rounded(rows.withColumn("pga_g", pga_g("distance_km")), "distance_km", "pga_g", digits=7)


@query
def prep_pga_by_event(spark, sf_dir):
    """Event and site values as columns: one job for several earthquakes."""
    rows = I.buildings(spark, sf_dir)
    rows = rows.selectExpr(
        "building_id",
        f"distance_mi * {KM_PER_MILE}D AS km",
        "5.0D + ground_floor_type * 0.5D AS magnitude",
        "-90.0D + ground_floor_type * 45.0D AS rake",
        "200.0D + age_building * 30.0D AS vs30",
    )
    pga = pga_g("km", "magnitude", "rake", "vs30")
    return rounded(rows.select("building_id", pga.alias("pga_g")), "pga_g", digits=7)


@query
def pga_per_distinct_distance(spark, sf_dir):
    """The same feature computed once per distinct distance and looked up."""
    rows = I.buildings(spark, sf_dir).select("building_id", "distance_mi")
    pga = blocks.compute_per_distinct(
        rows, "distance_mi", lambda d: d.withColumn("pga_g", pga_g(KM))
    )
    return rounded(pga.select("building_id", "pga_g"), "pga_g", digits=7)


@query
def prep_units_ratio(spark, sf_dir):
    rows = I.buildings(spark, sf_dir)
    height = S.metres_to_feet(F.col("total_height_m"))
    return rounded(
        rows.select(
            "building_id",
            height.alias("height_ft"),
            S.sq_metres_to_sq_feet(F.col("plinth_area_sq_ft")).alias("area_sq_ft"),
            S.ratio(height, F.col("count_floors_pre_eq")).alias("per_height_ft"),
            S.ratio(height, F.col("ground_floor_type")).alias("per_zero_ft"),
        ),
        "height_ft",
        "area_sq_ft",
        "per_height_ft",
        "per_zero_ft",
    )


@query
def label_map_filter(spark, sf_dir):
    """Letters to classes; rows with an unknown letter are dropped."""
    rows = I.foreign_survey(spark, sf_dir)
    grade = S.damage_class(F.col("Structural Damage (5-class)")).alias("damage_grade")
    kept, _ = drop_unlabelled(rows.select("Age", "Floor Area", grade), "damage_grade")
    return rounded(kept.withColumnsRenamed({"Age": "age", "Floor Area": "area"}), "area")


@query
def unlabelled_counts(spark, sf_dir):
    """Rows before, without a grade and after, observed while the data is read once."""
    rows = I.foreign_survey(spark, sf_dir)
    grade = S.damage_class(F.col("Structural Damage (5-class)"))
    kept, seen = drop_unlabelled(rows.select(grade.alias("damage_grade")), "damage_grade")
    after = kept.count()
    report = [(seen.get["rows_before"], seen.get["rows_unlabelled"], after)]
    return spark.createDataFrame(report, "rows_before long, rows_unlabelled long, rows_after long")


@query
def age_flags_constants(spark, sf_dir):
    rows = I.buildings(spark, sf_dir).select(
        "building_id",
        S.above(F.col("age_building"), 23).alias("non_engineered"),
        S.at_most(F.col("age_building"), 23).alias("engineered"),
    )
    return rows.withColumns({f"const_{c}": F.lit(v) for c, v in FOREIGN_CONSTANTS.items()})


@query
def prepare_home_survey(spark, sf_dir):
    """Raw home survey to its processed form: ground motion, renames, drops, target, imputation."""
    rows = I.buildings(spark, sf_dir)
    raw = rows.select(
        F.col("distance_mi").alias("district_distance_to_earthquakecenter(mi)"),
        "building_id",
        "count_floors_pre_eq",
        "age_building",
        "plinth_area_sq_ft",
        (3.0 * F.col("total_height_m")).alias("per-height_ft_pre_eq"),
        "foundation_type",
        F.col("roof_type").alias(
            "roof_type(Bamboo/Timber-Heavy roof=0; Bamboo/Timber-Light roof=1; RCC/RB/RBC=2)"
        ),
        "ground_floor_type",
        F.lit(0).alias("ward_id"),
        F.lit("flat").alias("land_surface_condition"),
        *SURVEY_FEATURES.flags,
        "damage_grade",
    )
    out = survey.prepare_home(survey.add_ground_motion(raw))
    SURVEY_FEATURES.validate(out)
    return rounded(
        out.withColumnRenamed("per-height_ft_pre_eq", "per_height_ft_pre_eq"),
        "PGA_g",
        "age_building",
        "per_height_ft_pre_eq",
        digits=7,
    )


@query
def prepare_foreign_survey(spark, sf_dir):
    out = survey.prepare_foreign(I.foreign_survey(spark, sf_dir), list(SURVEY_FEATURES.features))
    return rounded(
        out.withColumnRenamed("per-height_ft_pre_eq", "per_height_ft_pre_eq"),
        "PGA_g",
        "plinth_area_sq_ft",
        "per_height_ft_pre_eq",
    )


@query
def columns_in_header_order(spark, sf_dir):
    """Foreign columns in the order of a stored home survey, whose header alone is read."""
    home, path = I.buildings(spark, sf_dir), new_table_path(spark, "home-csv")
    tables.write_csv(home.select("roof_type", "age_building", "foundation_type", "damage_grade"), path)
    header = tables.csv_columns(spark, path)
    foreign = survey.shape_foreign(I.foreign_survey(spark, sf_dir))
    foreign = foreign.select("damage_grade", "PGA_g", "foundation_type", "age_building", "roof_type")
    aligned = S.align_columns(foreign, header, "damage_grade")
    counts = ", ".join(
        f"struct('{c}' AS column, {i} AS position, count({c}) AS n_values)"
        for i, c in enumerate(aligned.columns)
    )
    return aligned.agg(F.expr(f"array({counts}) AS counts")).selectExpr("inline(counts)")


@query
def zero_based_target(spark, sf_dir):
    return S.zero_base(I.buildings(spark, sf_dir).select("building_id", "damage_grade"), "damage_grade")


@query
def impute_median_mode(spark, sf_dir):
    rows = I.buildings(spark, sf_dir).select(
        "building_id", "distance_mi", "count_floors_pre_eq", "age_building", "roof_type", "foundation_type"
    )
    model = fit_impute(
        rows, ["distance_mi", "count_floors_pre_eq", "age_building"], ["roof_type", "foundation_type"]
    )
    return rounded(model.transform(rows), "distance_mi")


@query
def impute_from_train(spark, sf_dir):
    """Statistics of the training part fill the gaps of all parts."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", "distance_mi", "age_building", "roof_type")
    split = holdout_split(rows, "row_id", "y", 0.3, 0.3)
    model = Imputer(("distance_mi", "age_building"), ("roof_type",)).fit(
        split.filter(F.col("split") == "train")
    )
    return rounded(model.transform(split), "distance_mi")


@query
def column_report(spark, sf_dir):
    rows = I.buildings(spark, sf_dir)
    return rounded(
        describe_columns(
            rows, ["distance_mi", "count_floors_pre_eq", "age_building", "plinth_area_sq_ft", "damage_grade"]
        ),
        "lowest",
        "highest",
    )


@query
def scale_standard(spark, sf_dir):
    """Mean 0 and population deviation 1 on the training part, the same shift for the others."""
    columns = ["distance_mi", "plinth_area_sq_ft", "total_height_m"]
    rows = I.labelled(spark, sf_dir).select("row_id", "y", *columns)
    split = holdout_split(rows, "row_id", "y", 0.3)
    model = fit_scaler(split.filter(F.col("split") == "train"), columns)
    return rounded(model.transform(split), *columns)


# ---------------------------------------------------------------- encoding and splits

ENCODED = ("foundation_type", "roof_type", "ground_floor_type")


@query
def label_encode(spark, sf_dir):
    rows = I.buildings(spark, sf_dir).select("building_id", *ENCODED)
    return LabelEncoder(ENCODED).fit(rows).transform(rows)


@query
def label_encode_unseen(spark, sf_dir):
    """Codes of the home survey applied to the foreign one; values it lacks share code 0."""
    encoder = LabelEncoder(("market", "status"), start=1, unseen=0).fit(
        I.buildings(spark, sf_dir).select(F.col("roof_type").alias("market"), F.col("foundation_type").alias("status"))
    )
    flag = F.col("l_returnflag")
    rows = I.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", flag.alias("market"), F.col("l_linestatus").alias("status")
    )
    return encoder.transform(rows)


@query
def split_stratified(spark, sf_dir):
    rows = I.labelled(spark, sf_dir).select("row_id", "y")
    return holdout_split(rows, "row_id", "y", 0.3, 0.3)


@query
def split_plain(spark, sf_dir):
    return holdout_split(I.labelled(spark, sf_dir).select("row_id", "y"), "row_id", None, 0.3, seed=0)


@query
def kfold_stratified(spark, sf_dir):
    return stratified_folds(I.labelled(spark, sf_dir).select("row_id", "y"), "row_id", "y")


@query
def train_valid_union(spark, sf_dir):
    """Training and validation rows, by filter and by union of separate parts."""
    split = materialize(split_stratified(spark, sf_dir), "split")
    parts = [split.filter(F.col("split") == s) for s in ("train", "valid")]
    both = union_splits(*parts).groupBy("y").agg(F.count("*").alias("n_union"))
    kept = train_and_valid(split).groupBy("y").agg(F.count("*").alias("n_filter"))
    return both.join(kept, "y")


@query
def class_weight_table(spark, sf_dir):
    weights = class_weights.class_weights(I.labelled(spark, sf_dir), "y", C)
    return rounded(weights, "inverse", "log", "balanced")


# ---------------------------------------------------------------- probability algebra


@query
def softmax_argmax(spark, sf_dir):
    rows = I.embedding_logits(spark, sf_dir).withColumn("probs", F.expr(P.softmax("logits", C)))
    rows = rows.withColumn("y_pred", F.expr(P.argmax("probs"))).drop("logits")
    return spread(rows, "probs", "p")


@query
def softmax_with_temperature(spark, sf_dir):
    rows = I.signal_logits(spark, sf_dir).withColumn("probs", F.expr(P.softmax("logits", C, "2.5D")))
    return spread(rows.drop("logits"), "probs", "p")


@query
def entropy_margin(spark, sf_dir):
    """Confidence figures of all three models."""
    top1, top2 = P.top_two("probs", C)
    rows = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M).selectExpr(
        "row_id",
        "model",
        f"{top1} AS top1",
        f"{top2} AS top2",
        f"{P.margin('probs', C)} AS margin",
        f"{P.entropy('probs')} AS entropy",
    )
    return rounded(rows, "top1", "top2", "margin", "entropy")


@query
def onehot_residual(spark, sf_dir):
    rows = boost.residual(I.signal_logits(spark, sf_dir), "logits", "y", C, "r")
    n_set = f"cast(aggregate({P.one_hot('y', C)}, 0.0D, (s, v) -> s + v) AS int) AS n_set"
    return spread(rows.selectExpr("row_id", "y", "r", n_set), "r", "r")


@query
def block_width_check(spark, sf_dir):
    """Every block has the expected number of classes; a narrower one stops the query."""
    rows = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    widths = rows.selectExpr("model", f"size({P.checked_width('probs', C)}) AS width")
    return widths.groupBy("model", "width").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins of blocks


@query
def wide_from_long(spark, sf_dir):
    """Long prediction table to one row per building and back to named columns."""
    wide = blocks.wide_blocks(blocks.long_blocks(I.signal_predictions(spark, sf_dir), M), M, C)
    return spread(wide, M, [f"{m}_p" for m in M])


@query
def target_by_key(spark, sf_dir):
    """Features and target kept apart and put together by key."""
    rows = I.labelled(spark, sf_dir)
    joined = blocks.join_on_row(rows.select("row_id", "age_building"), rows.select("row_id", "y"))
    return joined.groupBy("y").agg(F.count("*").alias("n"), F.sum("age_building").alias("age_sum"))


@query
def oof_completeness(spark, sf_dir):
    """Blocks scored fold by fold, without the rows that have no roof type; the anti-join finds those."""
    rows = materialize(I.folded(spark, sf_dir), "folds")
    scored = []
    for k in range(5):
        model = FrequencyLearner({"by_roof": "roof_type"}, C).fit(rows.filter(F.col("fold") != k))
        own = rows.filter((F.col("fold") == k) & F.col("roof_type").isNotNull())
        scored.append(model.transform(own).filter("by_roof IS NOT NULL").withColumn("scored_in", F.lit(k)))
    oof = materialize(blocks.scatter_folds(scored), "oof")
    left = blocks.unscored_rows(rows, oof).select(F.lit(-1).alias("fold"))
    found = oof.select(F.col("scored_in").alias("fold"))
    return found.unionByName(left).groupBy("fold").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all three models."""
    rows = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    return rows.selectExpr("row_id", "y", "model", f"{P.argmax('probs')} AS y_pred")


BY_MODEL = ("model",)


@query
def confusion(spark, sf_dir):
    counts = metrics.confusion_counts(_predicted(spark, sf_dir), BY_MODEL)
    return metrics.confusion_matrix(counts, list(range(C)), BY_MODEL)


@query
def class_accuracy(spark, sf_dir):
    counts = metrics.confusion_counts(_predicted(spark, sf_dir), BY_MODEL)
    return rounded(metrics.class_accuracy(counts, BY_MODEL), "accuracy")


@query
def class_accuracy_skip_empty(spark, sf_dir):
    """Predicted classes that never occur have no accuracy: every second class is merged away."""
    rows = _predicted(spark, sf_dir).withColumn("y", (F.col("y") - F.col("y") % 2).cast("int"))
    counts = metrics.confusion_counts(rows, BY_MODEL)
    return rounded(metrics.class_accuracy(counts, BY_MODEL, empty="skip"), "accuracy")


@query
def f_scores(spark, sf_dir):
    """Per-class F1, and F2 as used for the macro F2 score."""
    counts = metrics.confusion_counts(_predicted(spark, sf_dir), BY_MODEL)
    f1 = metrics.class_scores(counts, BY_MODEL).select("model", "label", F.col("f_score").alias("f1"))
    f2 = metrics.class_scores(counts, BY_MODEL, beta=2.0).select("model", "label", F.col("f_score").alias("f2"))
    return rounded(f1.join(f2, ["model", "label"]), "f1", "f2")


@query
def macro_f2_by_model(spark, sf_dir):
    """Macro F2 of every model in one pass over the predictions."""
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    counts = metrics.confusion_counts(pred.withColumn("y_pred", F.expr(P.argmax("probs"))), ("model",))
    return rounded(metrics.macro_f_score(counts, ("model",)), "f_macro")


@query
def class_report(spark, sf_dir):
    counts = metrics.confusion_counts(_predicted(spark, sf_dir), BY_MODEL)
    return rounded(
        metrics.classification_report(counts, BY_MODEL, names=GRADE_NAMES), "precision", "recall", "f1"
    )


@query
def metrics_by_model(spark, sf_dir):
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    return rounded(
        metrics.model_report(pred, C), "accuracy", "f1_macro", "f1_weighted", "log_loss"
    )


@query
def auc_ovr(spark, sf_dir):
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    return rounded(metrics.auc_one_vs_rest(pred, ("model",)), "auc")


@query
def auc_mean(spark, sf_dir):
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    per_class = materialize(metrics.auc_one_vs_rest(pred, ("model",)), "auc")
    weighted = metrics.mean_auc(per_class, ("model",)).withColumnRenamed("auc", "auc_weighted")
    macro = metrics.mean_auc(per_class, ("model",), "macro").withColumnRenamed("auc", "auc_macro")
    return rounded(weighted.join(macro, "model"), "auc_weighted", "auc_macro")


@query
def auc_small_classes(spark, sf_dir):
    """Two classes of very different size with many tied scores."""
    labels = I.table(spark, sf_dir, "labels")
    length = (F.col("doc_id") % 7).cast("double") / 7.0
    pred = labels.select(F.col("quality").alias("y"), F.array(1.0 - length, length).alias("probs"))
    return rounded(metrics.auc_one_vs_rest(pred), "auc")


@query
def smoothed_cross_entropy(spark, sf_dir):
    rows = I.signal_logits(spark, sf_dir)
    weights = class_weights.weight_list(class_weights.class_weights(rows, "y", C), "inverse")
    return rounded(
        metrics.cross_entropy(rows, "logits", "y", weights, label_smoothing=0.05), "cross_entropy"
    )


@query
def focal_score(spark, sf_dir):
    rows = I.signal_logits(spark, sf_dir)
    weights = class_weights.weight_list(class_weights.class_weights(rows, "y", C), "log")
    return rounded(metrics.focal_score(rows, "logits", "y", weights), "cross_entropy", "focal")


# ---------------------------------------------------------------- blending


@query
def blend_weights(spark, sf_dir):
    """Clipped and normalised weights; all-negative rows get uniform ones."""
    rows = I.buildings(spark, sf_dir)
    raw = "array(ground_floor_type - 2.0D, building_id % 7 - 3.0D, building_id % 3 - 1.0D) AS raw"
    weights = rows.selectExpr("building_id", raw).select(
        "building_id", B.normalised_weights("raw", 3).alias("w")
    )
    return spread(weights, "w", "w", 3)


@query
def blend_uniform(spark, sf_dir):
    model = B.WeightedBlend(tuple(M), C, "uniform").fit(I.signal_predictions(spark, sf_dir))
    out = model.transform(I.signal_predictions(spark, sf_dir))
    return spread(out.select("row_id", "y", "y_pred", "probs"), "probs", "p")


@query
def blend_long_table(spark, sf_dir):
    """Weighted average straight from the long table, one shuffle by row."""
    pred = blocks.long_blocks(I.signal_predictions(spark, sf_dir), M)
    return spread(B.blended_long(pred, {"m0": 0.5, "m1": 0.25, "m2": 0.25}, C), "probs", "p")


@query
def blend_grid(spark, sf_dir):
    """Scores of all weight vectors in steps of 0.1."""
    wide = I.signal_predictions(spark, sf_dir)
    scores = B.candidate_scores(wide, M, C, B.simplex_grid(3))
    return rounded(spread(scores, "weights", "w", 3), "accuracy", "f1_macro", "f1_weighted")


@query
def blend_grid_best(spark, sf_dir):
    """The first best weight vector under weighted F1."""
    wide = I.signal_predictions(spark, sf_dir)
    best = B.best_candidate(B.score_candidates(wide, M, C, B.simplex_grid(3), "f1"))
    return rounded(spread(best, "weights", "w", 3), "score")


@query
def blend_grid_best_auc(spark, sf_dir):
    """The best weight vector of all three models under weighted AUC."""
    wide = I.signal_predictions(spark, sf_dir)
    best = B.best_weights(wide, M, C, B.simplex_grid(3), "auc")
    return rounded(spread(best, "weights", "w", 3), "score")


@query
def blend_grid_four_models(spark, sf_dir):
    """Scores of the 286 weight vectors of four models."""
    fourth = f"transform({array(I.signal_scores(3))}, v -> v / ({total(I.signal_scores(3))})) AS m3"
    wide = I.signal_predictions(spark, sf_dir).selectExpr("*", fourth)
    scores = B.candidate_scores(wide, [*M, "m3"], C, B.simplex_grid(4))
    return rounded(spread(scores, "weights", "w", 4), "accuracy", "f1_macro", "f1_weighted")


@query
def blend_search(spark, sf_dir):
    """Weights found for the accuracy itself, from the best of the grid on; scores as measured, and whether it converged."""
    wide = I.signal_predictions(spark, sf_dir)
    model = B.WeightedBlend(tuple(M), C, "pattern_search", "accuracy").fit(wide)
    row = [(*model.weights, model.uniform_score, model.fitted_score, model.converged)]
    names = ["w0", "w1", "w2", "uniform_accuracy", "fitted_accuracy"]
    schema = ", ".join(f"{c} double" for c in names) + ", converged boolean"
    return rounded(spark.createDataFrame(row, schema), *names)


@query
def blend_em_step(spark, sf_dir):
    shares = B.true_class_shares(I.signal_predictions(spark, sf_dir), M, C)
    return rounded(B.em_step(shares, [1 / 3, 1 / 3, 1 / 3]), "w0", "w1", "w2", "log_likelihood")


@query
def blend_optimised(spark, sf_dir):
    """A hundred likelihood steps, the most a fit takes by default, then the blended scores."""
    wide = I.signal_predictions(spark, sf_dir)
    model = B.WeightedBlend(tuple(M), C, "optimization", "accuracy", tol=0.0).fit(wide)
    row = [(*model.weights, model.uniform_score, model.fitted_score)]
    names = ["w0", "w1", "w2", "uniform_accuracy", "fitted_accuracy"]
    return rounded(spark.createDataFrame(row, ", ".join(f"{c} double" for c in names)), *names)


@query
def method_compare(spark, sf_dir):
    """Uniform, grid-search and optimised blends fitted on validation rows, compared on test rows."""
    split = materialize(
        holdout_split(I.signal_predictions(spark, sf_dir), "row_id", "y", 0.3, 0.3), "split"
    )
    valid, test = (split.filter(F.col("split") == s) for s in ("valid", "test"))
    fitted = {
        "uniform": B.WeightedBlend(tuple(M), C, "uniform").fit(valid),
        "grid_search": B.WeightedBlend(tuple(M), C, "grid_search", "f1").fit(valid),
        "optimization": B.WeightedBlend(tuple(M), C, tol=0.0).fit(valid),
    }
    report = diagnose.compare_methods(test, {k: m.transform for k, m in fitted.items()}, C)
    return rounded(report, "accuracy", "f1_macro", "f1_weighted", "log_loss")


# ---------------------------------------------------------------- stacking


def _frequency_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = materialize(I.folded(spark, sf_dir), "folds")
    return FrequencyLearner(I.FREQUENCY_KEYS, C).out_of_fold(folds)


@query
def oof_frequency(spark, sf_dir):
    """Out-of-fold class frequencies of three key columns."""
    wide = _frequency_blocks(spark, sf_dir).select("row_id", "y", "fold", *I.FREQUENCY_KEYS)
    return spread(wide, list(I.FREQUENCY_KEYS), [f"{m}_p" for m in I.FREQUENCY_KEYS])


@query
def survey_to_scores(spark, sf_dir):
    """From raw survey to model scores: ground motion, imputation, codes, folds, blend, metrics."""
    rows = I.labelled(spark, sf_dir)
    rows = rows.withColumn("PGA_g", pga_g(KM))
    rows = fit_impute(rows, ["PGA_g", "age_building"], ["roof_type"]).transform(rows)
    rows = rows.withColumn("pga_bin", F.floor(F.col("PGA_g") * 20.0)).withColumn(
        "age_bin", F.floor(F.col("age_building") / 10.0)
    )
    rows = LabelEncoder(("roof_type",)).fit(rows).transform(rows)
    keys = {"by_pga": "pga_bin", "by_age": "age_bin", "by_roof": "roof_type"}
    folds = stratified_folds(rows.select("row_id", "y", *keys.values()), "row_id", "y")
    folds = materialize(folds, "folds")
    oof = FrequencyLearner(keys, C).out_of_fold(folds)
    blend = B.WeightedBlend(tuple(keys), C, "uniform").fit(oof).transform(oof)
    pred = blocks.long_blocks(
        blend.withColumnRenamed("probs", "blend"), [*keys, "blend"]
    )
    return rounded(metrics.model_report(pred, C), "accuracy", "f1_macro", "f1_weighted", "log_loss")


def _meta(spark: SparkSession, sf_dir: str, layout: MetaLayout) -> DataFrame:
    wide = I.signal_predictions(spark, sf_dir)
    return rounded(layout.named(wide, ("row_id",)), *layout.slot_names())


@query
def meta_features(spark, sf_dir):
    return _meta(spark, sf_dir, MetaLayout(("m0", "m1", "m2"), C))


@query
def meta_features_short(spark, sf_dir):
    return _meta(spark, sf_dir, MetaLayout(("m0", "m1", "m2"), C, mean_entropy=False))


@query
def meta_features_mixed(spark, sf_dir):
    return _meta(spark, sf_dir, MetaLayout(("m0", "m1"), C, raw=("m2",)))


@query
def meta_dimension(spark, sf_dir):
    """Stored description of a stacked model, checked against meta-features before use."""
    layout = MetaLayout(("m0", "m1"), C, raw=("m2",))
    path = new_table_path(spark, "stack-info")
    stored.write_stack_metadata(spark, path, list(layout.models), layout.slot_names())
    info = stored.read_stack_metadata(spark, path)
    built = layout.assemble(I.signal_predictions(spark, sf_dir))
    stored.require_meta_dim(len(layout.slot_names()), info)
    return built.groupBy(F.size("meta").alias("meta_dim")).agg(F.count("*").alias("n"))


@query
def usage_share(spark, sf_dir):
    """Usage shares of a linear meta-learner whose weights are class means of the meta-features."""
    layout = MetaLayout(("m0", "m1"), C, raw=("m2",))
    meta = layout.assemble(I.signal_predictions(spark, sf_dir))
    n = len(layout.slot_names())
    means = meta.groupBy("y").agg(F.expr(f"array({', '.join(f'avg(meta[{s}])' for s in range(n))}) AS coefs"))
    coefficients = means.select(F.col("y").alias("output"), F.posexplode("coefs").alias("slot", "coef"))
    return rounded(diagnose.usage_share(coefficients, layout), "strength", "share")


@query
def ablation_blend(spark, sf_dir):
    """Loss of the uniform blend when a model's block becomes uniform."""
    model = B.WeightedBlend(tuple(M), C, "uniform").fit(I.signal_predictions(spark, sf_dir))
    wide = I.signal_predictions(spark, sf_dir)
    return rounded(
        diagnose.ablation_impact(wide, M, C, model.transform),
        "accuracy",
        "f1_macro",
        "accuracy_drop",
        "f1_macro_drop",
    )


# ---------------------------------------------------------------- calibration and boosting

TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0]


@query
def temperature_grid(spark, sf_dir):
    losses = calibrate.temperature_losses(I.signal_logits(spark, sf_dir), "logits", "y", C, TEMPERATURES)
    return rounded(losses, "nll")


@query
def temperature_fit(spark, sf_dir):
    """Temperature of least log loss, and the loss before and after."""
    rows = I.signal_logits(spark, sf_dir)
    model = calibrate.TemperatureScaling(C).fit(rows)
    pred = rows.selectExpr("y", f"{P.softmax('logits', C)} AS probs")
    before = metrics.model_report(pred, C, ()).select(F.col("log_loss").alias("nll_before"))
    after = metrics.model_report(model.transform(rows), C, ()).select(F.col("log_loss").alias("nll_after"))
    values = (model.temperature, before.first()[0], after.first()[0])
    out = spark.createDataFrame([values], "temperature double, nll_before double, nll_after double")
    return rounded(out, "temperature", "nll_before", "nll_after", digits=6)


@query
def calibrate_isotonic(spark, sf_dir):
    """Isotonic calibration of the out-of-fold frequencies of all three key columns."""
    names = list(I.FREQUENCY_KEYS)
    rows = materialize(_frequency_blocks(spark, sf_dir).select("row_id", "y", *names), "oof")
    for m in names:
        rows = calibrate.IsotonicCalibration(C, m).fit(rows).transform(rows).drop("y_pred")
    return spread(rows, names, [f"{m}_p" for m in names])


@query
def calibrate_many_scores(spark, sf_dir):
    """Isotonic calibration of a model with hundreds of different scores."""
    rows = I.signal_predictions(spark, sf_dir).selectExpr("row_id", "y", "transform(m0, v -> floor(v * 1000.0D) / 1000.0D) AS probs")
    rows = materialize(rows, "scores")
    out = calibrate.IsotonicCalibration(C).fit(rows).transform(rows)
    return spread(out.select("row_id", "y", "probs"), "probs", "p")


@query
def calibrate_cross(spark, sf_dir):
    """Calibration on three folds: the mean of three learners, each calibrated on the fold it has not seen."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", "roof_type")
    learner = FrequencyLearner({"by_roof": "roof_type"}, C)
    model = CrossCalibration(learner, C, k=3, block="by_roof").fit(rows)
    return spread(model.transform(rows).select("row_id", "y", "probability"), "probability", "p")


BOOST_KEYS = ["foundation_type", "roof_type", "ground_floor_type"]


@query
def boost_group_mean(spark, sf_dir):
    """Three group-mean learners boosted on the training part; summed outputs for all rows."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", *BOOST_KEYS)
    split = materialize(
        holdout_split(rows, "row_id", "y", 0.0, 0.3, seed=1), "split"
    )
    model = boost.Booster(tuple(boost.GroupMean(k) for k in BOOST_KEYS), C).fit(split)
    return spread(model.transform(split).select("row_id", "y", "scores"), "scores", "s")


@query
def boost_accuracy(spark, sf_dir):
    """Training and validation accuracy after each boosting step."""
    rows = I.labelled(spark, sf_dir).select("row_id", "y", *BOOST_KEYS)
    split = materialize(holdout_split(rows, "row_id", "y", 0.0, 0.3, seed=1), "split")
    model = boost.Booster(tuple(boost.GroupMean(k) for k in BOOST_KEYS), C).fit(split)
    steps = [(i, t, v) for i, (t, v) in enumerate(model.history)]
    out = spark.createDataFrame(steps, "step int, train_accuracy double, valid_accuracy double")
    return rounded(out, "train_accuracy", "valid_accuracy")


# ---------------------------------------------------------------- transfer and predict-only models

def stored_again(spark: SparkSession, model):
    """The model as another session would read it."""
    path = new_table_path(spark, "model")
    save_model(spark, model, path)
    return load_model(spark, path)


TRANSFER_KEYS = {
    "by_floors": "count_floors_pre_eq",
    "by_engineered": "has_superstructure_rc_engineered",
    "by_ground_floor": "ground_floor_type",
}


@query
def transfer_metrics(spark, sf_dir):
    """Models fitted on the home survey, stored, read again and scored at home and on the foreign survey, with their blend."""
    home = I.buildings(spark, sf_dir).select(
        "count_floors_pre_eq",
        F.col("has_superstructure_rc_engineered").cast("int").alias("has_superstructure_rc_engineered"),
        "ground_floor_type",
        (F.col("damage_grade") - 1).alias("y"),
    )
    imputer = stored_again(spark, Imputer(("count_floors_pre_eq",)).fit(home))
    foreign = survey.shape_foreign(I.foreign_survey(spark, sf_dir)).select(
        F.col("count_floors_pre_eq").cast("long").alias("count_floors_pre_eq"),
        "has_superstructure_rc_engineered",
        "ground_floor_type",
        F.col("damage_grade").alias("y"),
    )
    names = list(TRANSFER_KEYS)
    home, foreign = imputer.transform(home), imputer.transform(foreign)
    model = stored_again(spark, FrequencyLearner(TRANSFER_KEYS, C).fit(home))
    both = union_splits(
        home.withColumn("domain", F.lit("home")), foreign.withColumn("domain", F.lit("foreign"))
    )
    scored = model.transform(both).withColumn("blend", B.blended(names, [1 / 3] * 3, C))
    pred = blocks.long_blocks(scored, [*names, "blend"], ("domain", "y"))
    report = metrics.model_report(pred, C, ("domain", "model"))
    return rounded(report, "accuracy", "f1_macro", "f1_weighted", "log_loss")


# Fixed weights of the linear model: row k adds k+1 times the k-th input, alternating in sign.
LINEAR_INPUTS = ["plinth_area_sq_ft", "total_height_m", "flag_sum"]


def _load_linear():
    weights = np.array([[(k + 1) * 0.0001, -(k + 1) * 0.02, (k + 1) * 0.1] for k in range(C)])
    return lambda batch: batch.to_numpy(dtype="float64") @ weights.T


@query
def score_linear_model(spark, sf_dir):
    """A predict-only model in Arrow batches, its logits turned into probabilities on the JVM."""
    rows = I.labelled(spark, sf_dir)
    rows = rows.selectExpr("*", f"cast({total(SURVEY_FEATURES.flags)} AS double) AS flag_sum")
    scored = score_in_batches(rows, _load_linear, ["row_id", "y"], LINEAR_INPUTS)
    scored = scored.withColumn("probs", F.expr(P.softmax("logits", C)))
    return spread(scored.select("row_id", "y", "probs"), "probs", "p")


# ---------------------------------------------------------------- MLlib learners

ML_INPUTS = [
    "pga_g",
    "floors",
    "age_building",
    "plinth_area_sq_ft",
    "foundation_code",
    "floor_code",
    "hint_a",
    "hint_b",
]


def ml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors with two columns that tell something about the class, folds and splits."""
    rows = I.labelled(spark, sf_dir)
    hints = I.signal_scores(0)
    rows = rows.select(
        "row_id",
        "y",
        F.coalesce(pga_g(KM), F.lit(0.0)).alias("pga_g"),
        (F.col("total_height_m") / 3.0).alias("floors"),
        F.coalesce(F.col("age_building").cast("double"), F.lit(30.0)).alias("age_building"),
        (F.col("plinth_area_sq_ft") / 1000.0).alias("plinth_area_sq_ft"),
        F.ascii("foundation_type").cast("double").alias("foundation_code"),
        F.col("ground_floor_type").cast("double").alias("floor_code"),
        F.expr(f"cast({P.argmax_of(hints)} AS double) AS hint_a"),
        F.expr(f"({hints[0]}) / 100.0D AS hint_b"),
    )
    vectors = stack.to_vector(rows, ML_INPUTS).select("row_id", "y", "features")
    return materialize(holdout_split(vectors, "row_id", "y", 0.3, folds=5), "learning")


def _report(scored: DataFrame) -> DataFrame:
    counts = metrics.confusion_counts(scored.filter(F.col("split") == "test"), y_pred="y_pred")
    return rounded(metrics.summary_scores(counts), "accuracy", "f1_macro", "f1_weighted")


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") != "test")


#: Settings from the declared grids: of each parameter the first, and the larger step.
FOREST = {p: values[0] for p, values in stack.FOREST_GRID.items()}
BOOSTED = {p: values[0] for p, values in stack.SHALLOW_BOOSTED_GRID.items()} | {"stepSize": 0.1}


@query
def base_random_forest(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    model = stack.random_forest(rowCol="row_id", **FOREST).fit(_train(rows))
    scored = stack.score_blocks(rows, {"forest": model}, C)
    return _report(scored.withColumn("y_pred", F.expr(P.argmax("forest"))))


@query
def base_gbt_ovr(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    model = stack.boosted_trees(rowCol="row_id", **BOOSTED).fit(_train(rows))
    scored = stack.score_blocks(rows, {"trees": model}, C)
    return _report(scored.withColumn("y_pred", F.expr(P.argmax("trees"))))


def _bases(train: DataFrame) -> dict:
    return {
        "forest": stack.random_forest(rowCol="row_id", **FOREST),
        "logistic": stack.logistic_meta(train.count()),
    }


def _one_hot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds and one input per ground floor type."""
    rows = I.folded(spark, sf_dir)
    marks = {f"k{k}": (F.col("ground_floor_type") == k).cast("double") for k in range(C)}
    vectors = stack.to_vector(rows.withColumns(marks), list(marks))
    return materialize(vectors.select("row_id", "y", "fold", "ground_floor_type", "features"), "marks")


@query
def logistic_saturated(spark, sf_dir):
    """The meta-learner without a penalty on a one-hot key: its probabilities are the class shares of the key."""
    rows = _one_hot_rows(spark, sf_dir)
    learner = stack.logistic_meta(rows.count(), 1e12).setTol(1e-12)
    scored = stack.score_blocks(rows, {"logistic": learner.fit(rows)}, C)
    means = [F.avg(F.col("logistic")[k]).alias(f"p{k}") for k in range(C)]
    return rounded(scored.groupBy("ground_floor_type").agg(*means), *[f"p{k}" for k in range(C)], digits=4)


@query
def logistic_out_of_fold(spark, sf_dir):
    """The same out of fold: shares of the key among the rows of the other folds."""
    rows = _one_hot_rows(spark, sf_dir)
    learner = stack.logistic_meta(rows.count(), 1e12).setTol(1e-12)
    scored = stack.out_of_fold(rows, {"logistic": learner}, C, 5)
    means = [F.avg(F.col("logistic")[k]).alias(f"p{k}") for k in range(C)]
    out = scored.groupBy("ground_floor_type", "fold").agg(*means)
    return rounded(out, *[f"p{k}" for k in range(C)], digits=4)


@query
def stack_logreg(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    train = _train(rows)
    model = stack.StackingEnsemble(_bases(train), C, 5, c=0.2, balanced=True, enhanced=True).fit(train)
    return _report(model.transform(rows))


@query
def stack_mlp(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    train = _train(rows)
    bases = _bases(train)
    layout = MetaLayout(tuple(bases), C)
    network = stack.network_meta(len(layout.slot_names()), C, stack.HIDDEN_LAYERS["single"], "_meta")
    model = stack.StackingEnsemble(bases, C, 5, enhanced=True, meta=network).fit(train)
    return _report(model.transform(rows))


@query
def stack_ablation(spark, sf_dir):
    """Ablation and usage of a stacked model with an MLlib meta-learner."""
    rows = ml_rows(spark, sf_dir)
    bases = _bases(_train(rows))
    model = stack.StackingEnsemble(bases, C, 5, enhanced=True).fit(_train(rows))
    wide = materialize(
        stack.score_blocks(rows.filter(F.col("split") == "test"), model.base_models, C).drop("features"),
        "blocks",
    )
    impact = diagnose.ablation_impact(wide, list(bases), C, model.predict_blocks)
    share = diagnose.usage_share(model.coefficients(rows), model.layout)
    out = impact.join(share, F.col("ablated") == F.col("model"), "left").drop("model", "strength")
    return rounded(out, "accuracy", "f1_macro", "accuracy_drop", "f1_macro_drop", "share")


@query
def cv_grid(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    forest = stack.random_forest(rowCol="row_id")
    grid = stack.parameter_grid(forest, stack.FOREST_GRID)
    search = stack.grid_search(_train(rows), forest, grid, k=5)
    return rounded(stack.grid_table(rows, search), "accuracy")


@query
def boost_regression_trees(spark, sf_dir):
    """Boosting with an MLlib regressor per class, as many stages as the boosted trees have rounds."""
    rows = ml_rows(spark, sf_dir).withColumn(
        "split", F.when(F.col("split") == "test", "valid").otherwise("train")
    )
    tree = DecisionTreeRegressor(featuresCol="features", maxDepth=BOOSTED["maxDepth"], seed=42)
    learners = (boost.RegressorPerClass(tree),) * BOOSTED["maxIter"]
    rates = (BOOSTED["stepSize"],) * len(learners)
    model = boost.Booster(learners, C, rates).fit(rows)
    scored = model.transform(rows)
    hit = (F.col("y") == F.col("y_pred")).cast("double")
    return rounded(scored.groupBy("split").agg(F.avg(hit).alias("accuracy")), "accuracy")

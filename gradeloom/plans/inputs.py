"""Survey-like and prediction tables derived from the test tables, row for row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.text import array, slots, total
from gradeloom.operators.split import stratified_folds
from gradeloom.spec import FLAG_COLUMNS

N_CLASSES = 5
EMBEDDING_SIZE = 64
SIGNAL_MODELS = ["m0", "m1", "m2"]
FREQUENCY_KEYS = {
    "by_foundation": "foundation_type",
    "by_roof": "roof_type",
    "by_ground_floor": "ground_floor_type",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home survey: one building per order, with gaps in some columns."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    flags = [f"shiftright(o_orderkey, {i}) & 1 AS {f}" for i, f in enumerate(FLAG_COLUMNS)]
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS building_id",
        "cast(substr(o_orderpriority, 1, 1) AS int) AS damage_grade",
        "if(o_orderkey % 17 != 0, 1.0D + o_totalprice / 10000.0D, NULL) AS distance_mi",
        "if(o_orderkey % 13 != 0, 1 + o_custkey % 9, NULL) AS count_floors_pre_eq",
        "if(o_orderkey % 11 != 0, o_orderkey % 60, NULL) AS age_building",
        "abs(c_acctbal) AS plinth_area_sq_ft",
        "3.0D * (1 + o_custkey % 9) AS total_height_m",
        "o_orderstatus AS foundation_type",
        "if(o_orderkey % 19 != 0, c_mktsegment, NULL) AS roof_type",
        "c_nationkey % 5 AS ground_floor_type",
        *flags,
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home survey with ``row_id`` and the zero-based class ``y``."""
    return (
        buildings(spark, sf_dir)
        .withColumnRenamed("building_id", "row_id")
        .withColumn("y", F.col("damage_grade") - 1)
        .drop("damage_grade")
    )


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, folds and the key columns of the frequency learners."""
    rows = labelled(spark, sf_dir).select("row_id", "y", *FREQUENCY_KEYS.values())
    return stratified_folds(rows, "row_id", "y")


def foreign_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign survey under its raw headers: one building per line item; grade X is unknown."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_quantity")).alias("Age"),
        (F.col("l_linenumber") % 7).alias("No Stories"),
        (0.05 + F.col("l_discount")).alias("PGA_max"),
        (3.0 * F.col("l_linenumber")).alias("Total Height"),
        (F.col("l_extendedprice") / 100.0).alias("Floor Area"),
        F.substring(F.lit("NLMSCX"), (1 + F.col("l_partkey") % 6).cast("int"), F.lit(1)).alias(
            "Structural Damage (5-class)"
        ),
    )


def signal_scores(model: int) -> list[str]:
    """Integer-valued scores of a model that favours class ``(y + model) mod 5``, as SQL text."""
    return [
        f"1.0D + (row_id * {(model + 2) * (k + 3)}) % 97 + if((y + {model}) % {N_CLASSES} = {k}, 20.0D, 0.0D)"
        for k in range(N_CLASSES)
    ]


def signal_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide prediction table of three models whose classes carry a signal."""
    rows = labelled(spark, sf_dir).select("row_id", "y")
    scores = [f"{array(signal_scores(m))} AS {name}" for m, name in enumerate(SIGNAL_MODELS)]
    shares = [
        f"{array(f'{s} / {total(slots(m, N_CLASSES))}' for s in slots(m, N_CLASSES))} AS {m}"
        for m in SIGNAL_MODELS
    ]
    return rows.selectExpr("row_id", "y", *scores).selectExpr("row_id", "y", *shares)


def signal_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits with a signal: the scores of the first model over 10."""
    rows = labelled(spark, sf_dir).select("row_id", "y")
    return rows.selectExpr("row_id", "y", f"{array(f'({s}) / 10.0D' for s in signal_scores(0))} AS logits")


def embedding_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits from all elements of each embedding: class k adds up every fifth one from the k-th on."""
    logits = array(
        total(f"cast(embedding[{j}] AS double)" for j in range(k, EMBEDDING_SIZE, N_CLASSES)) for k in range(N_CLASSES)
    )
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS row_id", f"label % {N_CLASSES} AS y", f"{logits} AS logits"
    )

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gradeloom.plans.learners import QUERIES  # noqa: E402
from gradeloom.sources.shared import temporary_tables  # noqa: E402

HEADLINE = [
    "prep_pga",
    "prepare_home_survey",
    "prepare_foreign_survey",
    "impute_median_mode",
    "label_encode",
    "split_stratified",
    "kfold_stratified",
    "wide_from_long",
    "class_report",
    "metrics_by_model",
    "auc_ovr",
    "smoothed_cross_entropy",
    "blend_uniform",
    "blend_grid",
    "blend_grid_best_auc",
    "blend_optimised",
    "oof_frequency",
    "survey_to_scores",
    "meta_features",
    "ablation_blend",
    "temperature_fit",
    "calibrate_isotonic",
    "boost_group_mean",
    "transfer_metrics",
    "score_linear_model",
    "base_random_forest",
    "boosted_softmax",
    "ordered_statistics",
    "network_meta_learners",
    "calibrate_cross",
    "stack_logreg",
]


#: Seconds after which a query is ended; it is then listed as unfinished. Otherwise one slow query would leave no figures.
QUERY_SECONDS = float(os.environ.get("BENCH_QUERY_SECONDS", "400"))


def run(spark: SparkSession, query: str, sf_dir: str) -> bool:
    """Run a query to its end; False if it was ended because of its time."""
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(QUERY_SECONDS):
            late.set()
            while not done.wait(1.0):  # learners start job after job, some from threads of their own
                spark.sparkContext.cancelAllJobs()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception:
        if not late.is_set():
            raise
    finally:
        done.set()
        watcher.join()
    return not late.is_set()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gradeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Methods over 8000 bytes are never compiled by the JVM; split them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["metrics_by_model"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, unfinished = {}, []
    for query in sys.argv[1:] or HEADLINE:
        with temporary_tables(spark):
            start = time.perf_counter()
            if not run(spark, query, sf_dir):
                unfinished.append(query)
            seconds[query] = round(time.perf_counter() - start, 3)
        print(query, seconds[query], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "unfinished": unfinished,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

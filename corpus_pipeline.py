"""From raw documents to tokens: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; stages are written as Parquet and read
again. All but the last return the columns of ``docs``. A stage bounds the Arrow batches of its session, since
texts may be long and its result is written after it has returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.llm import bpe, familiar, jaccard, language, postings, quality
from gradeloom.llm.stored import bound_batches
from gradeloom.sources.shared import materialize

KEEP_QUALITY = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _row_key(docs: DataFrame) -> Column:
    """Identity of a row by its values: rows that agree in all columns share it. The id comes first in its order."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.struct(F.col("doc_id"), F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit(1), *columns[::-1]).alias("y"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """``docs`` with the identity of each row, and the names of that column and of its two hashes, which no column has."""
    taken, names = {c.lower() for c in docs.columns}, []
    for made in ("row_key", "row_x", "row_y"):
        while made in taken:
            made = f"_{made}"
        names.append(made)
    key = _row_key(docs)
    return docs.withColumns(dict(zip(names, (key, key["x"], key["y"])))), names[0], names[1:]


def _hashes(names: list[str]) -> list[str]:
    return [f"doc_key.{part} AS {made}" for part, made in zip("xy", names)]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality model scores ``KEEP_QUALITY`` or more.

    The model learns from the labelled ones among them. Null and empty texts are scored as texts without words;
    repeated rows all stay or all go.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(materialize(quality.text_features(docs), "features"), labels)
    return quality.with_quality(docs, model).where(f"quality_score >= {KEEP_QUALITY}D").select(docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as the language found for them, or as a seldom one: not those without letters, letter junk,
    nor those in a language without labelled rows.

    Network and profiles learn from the documents with a language, evenly from all languages, however rare. Without
    such documents all those with a letter stay.
    """
    bound_batches(spark)
    windows, labels = language.labelled_windows(docs)
    familiarity = familiar.fit_familiarity(windows, labels)
    if familiarity is None:
        return docs.where(r"coalesce(text RLIKE '\\p{L}', false)")
    found = language.with_language(docs, language.train_documents(windows, labels), "text", familiarity)
    return found.where(f"lang_pred <> '{language.UNDETERMINED}'").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word shingles at a similarity of 0.8 or more.

    Documents without words are groups of their own; of rows that agree in all columns one stays.
    """
    bound_batches(spark)
    keyed, key, hashes = _keyed(docs)
    groups = jaccard.jaccard_groups(keyed, key, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    kept = groups.where("doc_key = group_key").selectExpr(*_hashes(hashes)).distinct()
    rows = keyed.drop(key).join(kept, hashes, "left_semi")
    return rows.dropDuplicates(hashes).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    bound_batches(spark)
    keyed, key, hashes = _keyed(docs)
    found = postings.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    hit = found.where("contaminated").selectExpr(*_hashes(hashes)).distinct()
    return keyed.join(hit, hashes, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the tokens of each document, with its id, language and source; null texts have none."""
    bound_batches(spark)
    encoded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.drop("text", "decoded")


STAGES = [
    ("quality", keep_good),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]

#: The models of the first two stages are trained, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

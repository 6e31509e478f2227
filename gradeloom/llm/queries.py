"""One query per operator over whole tables, in the form fixed for its results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import (
    bpe, codebooks, collocations, html_text, jaccard, language, licences, lines, near_vectors, postings, quality, rollups, urls,
)
from gradeloom.sources.shared import materialize, new_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 10-word windows of benchmark items."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return postings.contamination(docs, benchmark).select(
        F.col("doc_key").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings with a cosine of 0.95 or more."""
    found = near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.selectExpr("vec_key AS vec_id", "n_links", "group_key AS component_id", "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by the recurrent network."""
    found = language.languages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("doc_key", "doc_id")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of each document: how many, their families, and the families that a notice confirms."""
    found = licences.licence_scan(table(spark, sf_dir, "documents"))
    names = "array_join(array_sort(array_distinct(transform({}, p -> p.family))), ',')"
    return found.selectExpr(
        "doc_key AS doc_id",
        "n_paragraphs",
        "cast(size(found) AS long) AS n_found",
        names.format("found") + " AS families",
        names.format("filter(found, p -> p.confirmed)") + " AS confirmed",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of each document with a public byte-level vocabulary, and the text decoded from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_texts(docs, path, ids=False).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by the additive model."""
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.selectExpr("doc_key AS doc_id", "held_out", "score", "int(score >= 0.7D) AS predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The rules of the URL query.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL."""
    judged = urls.judged_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Documents below so many words are deleted, and documents in this language are counted anew, in the rollup query.
SHORT_WORDS = 20
RECOUNTED = "fr"


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after inserts, deletes and revised counts of all documents, some batches committed twice."""
    counts = materialize(rollups.token_counts(table(spark, sf_dir, "documents")), "counts")
    rollup = rollups.Rollup(spark, new_table_path(spark, "rollup"))
    every = rollups.by_tokenizer(counts)
    rollup.commit(0, rollups.inserts(every.where("tokenizer = 'blank-1'")))
    rollup.commit(1, rollups.inserts(every.where("tokenizer = 'alnum-1'")))
    short = rollups.by_tokenizer(counts.where(f"counts['blank-1'] < {SHORT_WORDS}"))
    long = counts.where(f"counts['blank-1'] >= {SHORT_WORDS} AND lang = '{RECOUNTED}'")
    recounted = long.selectExpr("source", "lang", "'blank-1' AS tokenizer", "counts['blank-1'] AS n_tokens", "counts['alnum-1'] AS again")
    for _ in range(2):  # a job that starts again commits the same batches
        rollup.commit(2, rollups.deletes(short))
        rollup.commit(3, rollups.revisions(recounted, "again"))
    return rollup.totals()


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 4-word shingles at a similarity of 0.85."""
    groups = jaccard.jaccard_groups(table(spark, sf_dir, "documents"))
    return groups.selectExpr("doc_key AS doc_id", "n_shingles", "group_key AS component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings from codebooks of 16 entries for 8 parts, trained in 6 rounds."""
    coded = codebooks.vector_codes(table(spark, sf_dir, "embeddings"))
    return codebooks.with_label_error(coded.rows).select(
        F.col("vec_key").alias("vec_id"), "code", "error", "label_error", F.lit(coded.sha256()).alias("codebooks_sha256")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more."""
    kept = lines.without_common_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("doc_key").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_vectors": op2_near_vectors,
    "op3_language": op3_language,
    "op4_licences": op4_licences,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_url_filter": op8_url_filter,
    "op9_token_rollup": op9_token_rollup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

"""Token totals by source, language and tokenizer version, maintained by signed changes.

A batch of changes (inserts, deletes, revised counts) is reduced to one signed row per group and committed under its
batch number. Totals are sums over committed batches, so they are additive: nothing is recounted. Committing a
batch again replaces that batch and nothing else, so a repeated or restarted job changes no total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.functions.text import text as literal
from gradeloom.llm.blocks import ALPHANUMERIC, NOT_BLANK, Splitter, slices, text_bytes
from gradeloom.llm.bpe import TextCodec

GROUP = ("source", "lang", "tokenizer")
#: Tokenizer versions that are counted here: runs without blanks, and runs of letters and digits.
TOKENIZERS = {"blank-1": NOT_BLANK, "alnum-1": ALPHANUMERIC}
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch long"


def token_counts(
    docs: DataFrame, text: str = "text", tokenizers: tuple[str, ...] = tuple(TOKENIZERS), vocabularies: dict[str, str] | None = None
) -> DataFrame:
    """``source, lang, counts map<string, long>``: for each row of ``docs`` its tokens by tokenizer version.

    ``vocabularies`` adds versions counted with the tokens of ``bpe.encode_texts``: a vocabulary file for each name.
    Null and empty texts have 0 tokens. Only the three columns are read; extra columns and repeated rows do no harm.
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("source", "lang")]
    rows = docs.select(*columns, F.col(text).cast("string").alias("text"))
    vocabularies = vocabularies or {}
    files = {}
    for t, path in vocabularies.items():
        with open(path, encoding="utf-8") as f:
            files[t] = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [f"n{k}" for k in range(len(tokenizers) + len(files))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [Splitter(TOKENIZERS[t]) for t in tokenizers]
        codecs = [TextCodec(f.value) for f in files.values()]
        for batch in slices(batches, "text"):
            counts = [pa.array(np.diff(s(batch.column("text")).first), pa.int64()) for s in split]
            counts += [pa.array(np.diff(c.encode(*text_bytes(batch.column("text")))[1]), pa.int64()) for c in codecs]
            columns = [batch.column("source"), batch.column("lang"), *counts]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "lang", *names])

    counted = rows.mapInArrow(run, "source string, lang string, " + ", ".join(f"{n} long" for n in names))
    pairs = ", ".join(f"{literal(t)}, {n}" for t, n in zip((*tokenizers, *files), names))
    return counted.selectExpr("source", "lang", f"map({pairs}) AS counts")


def by_tokenizer(counts: DataFrame) -> DataFrame:
    """``source, lang, tokenizer, n_tokens``: a row for each row and tokenizer version of ``counts``."""
    return counts.selectExpr("source", "lang", "explode(counts) AS (tokenizer, n_tokens)")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add the counted documents."""
    return counts.selectExpr(*GROUP, "cast(NULL AS long) AS old", "coalesce(n_tokens, 0L) AS new")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take the counted documents away again."""
    return counts.selectExpr(*GROUP, "coalesce(n_tokens, 0L) AS old", "cast(NULL AS long) AS new")


def revisions(counts: DataFrame, new: str) -> DataFrame:
    """Changes of the counts of documents to column ``new``, in the same group."""
    return counts.selectExpr(*GROUP, "coalesce(n_tokens, 0L) AS old", f"coalesce(`{new}`, 0L) AS new")


def signed(changes: DataFrame) -> DataFrame:
    """One signed row per group. ``old`` and ``new`` are a document's count before and after; null means not there."""
    return changes.groupBy(*GROUP).agg(
        F.sum(F.expr("int(new IS NOT NULL) - int(old IS NOT NULL)")).alias("n_docs"),
        F.sum(F.expr("coalesce(new, 0L) - coalesce(old, 0L)")).alias("n_tokens"),
    )


class Rollup:
    """Totals in a folder: Parquet partitions by batch number. Null sources and languages are groups of their own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Reduce the changes and make them the content of batch ``batch``, whatever it held before.

        An empty batch leaves a row without effect, so that it also replaces what was there.
        """
        if batch < 0:
            raise ValueError("batch numbers start at 0")
        empty = self.spark.createDataFrame([(None, None, None, 0, 0, batch)], SCHEMA)
        rows = signed(changes).withColumn("batch", F.lit(batch).cast("long")).unionByName(empty)
        # The reduce tasks write their own groups: no task takes the groups or the map outputs of all.
        rows.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of the groups that have documents or tokens."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where("n_docs <> 0 OR n_tokens <> 0")
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def batches(self) -> DataFrame:
        """Numbers of the committed batches."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).select("batch").distinct()

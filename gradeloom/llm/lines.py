"""Line dedup: lines that stand in many documents are dropped wherever they stand.

Lines are exploded as 128-bit hashes of their normalised form, each once per document, and documents are counted
per hash. Only hashes move: the ones found in too many documents go back to the documents that hold them, and
there the other lines are put together again in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import slices
from gradeloom.llm.stored import small_batches, store
from gradeloom.sources.shared import materialize


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """Hash of each line's key, in order: blanks stripped, A-Z lower-cased. None for keys shorter than ``min_chars``."""
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r")
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long_enough else None)
    return out


def _distinct_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            lines = [list(set(line_hashes(t or b"", min_chars)) - {None}) for t in texts]
            parts = [batch.column(c) for c in ("key", "x", "y")] + [pa.array(lines, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(parts, names=["key", "x", "y", "lines"])

    return run


def _reassembled(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_lines, n_dropped = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, gone in zip(texts, batch.column("gone").to_pylist()):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                if gone:
                    gone = set(gone)
                    stay = [li for li, h in zip(text.split(b"\n"), line_hashes(text, min_chars)) if h not in gone]
                    n_dropped.append(n_lines[-1] - len(stay))
                    text = b"\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_key", "n_lines", "n_dropped", "text"],
            )

    return run


def without_common_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Texts without the lines whose keys stand in ``min_docs`` documents or more.

    Returns ``doc_key`` (the value of ``key``), ``n_lines long`` (before), ``n_dropped long`` and ``text`` (the other
    lines, joined by \\n, as they were). Lines end at \\n. A line's key is the line without blanks (space, \\t to \\r) at
    both ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points are never dropped.

    Every row is a document: repeated rows and rows that share a key count each, and each is returned. A null or
    empty text is one empty line; null keys are kept; an empty table gives no rows; other columns are not read. A line
    is dropped exactly when ``min_docs`` documents hold its key, so there are no ties. A text is handled whole by
    one task.

    Rows with the same key and text are told apart by nothing, so the hashes to drop are gathered per key and text:
    never more than one text's lines. The count of a line that all documents share is summed up map-side. ``docs``
    is evaluated twice and must give the same rows.
    """
    value = F.col(text).cast("string")
    identity = F.xxhash64(value).alias("x"), F.xxhash64(F.lit(1), value).alias("y")
    source = docs.select(F.col(key).alias("key"), *identity, value.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        _, hashed = store(
            source.mapInArrow(_distinct_hashes(min_chars), f"key {kind}, x long, y long, lines array<binary>"), "lines"
        )
    counts = hashed.select(F.explode("lines").alias("line")).groupBy("line").count()
    common = materialize(counts.where(F.col("count") >= min_docs).select("line"), "common")
    hits = hashed.select("key", "x", "y", F.explode("lines").alias("line")).join(common, "line", "left_semi")
    gone = hits.groupBy(F.col("key").alias("k"), F.col("x").alias("kx"), F.col("y").alias("ky")).agg(
        F.collect_set("line").alias("gone")
    )
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("x") == F.col("kx")) & (F.col("y") == F.col("ky"))
    rows = source.join(gone, same, "left").select("key", "text", "gone")
    return rows.mapInArrow(_reassembled(min_chars), f"doc_key {kind}, n_lines long, n_dropped long, text string")

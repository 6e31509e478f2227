"""Compression of vectors to short codes: a codebook per part of the vector, trained by active-entry Lloyd rounds.

A vector of integers is cut into equal parts, and each part is replaced by the number of the nearest entry of its
codebook. A round assigns every part and moves every entry to the floor of the mean of its parts. The table of a round
keeps, for each part, its entry and the exact distance to it. In the next round a part whose entry did not move
compares only the entries that did move with that distance: all other entries are where they were, and none of them
was nearer. A part whose entry moved is compared with all entries.

Everything is integer arithmetic, and equal distances go to the lower index, so the codes do not depend on
how the rows are spread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.stored import remove, small_batches, store
from gradeloom.sources.shared import materialize

#: Rows whose distances a task computes at once.
CHUNK_ROWS = 4096


class Coded(NamedTuple):
    """``rows``: vec_key, label, code, error; ``codebooks``: integers by part, entry and place within the part."""

    rows: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        """Hash of all entries' decimal components, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.codebooks.ravel()).encode()).hexdigest()


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``values`` (rows, width) to ``entries`` (entries, width), as integers."""
    if not len(values) or not len(entries):
        return np.zeros((len(values), len(entries)), np.int64)
    top = max(int(np.abs(values).max()), int(np.abs(entries).max()))
    if 4 * values.shape[1] * top * top < 1 << 53:  # all terms are exact as doubles
        v, e = values.astype(np.float64), entries.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2.0 * (v @ e.T) + (e * e).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(values), len(entries)), np.int64)
    for k in range(values.shape[1]):
        out += (values[:, k, None] - entries[None, :, k]) ** 2
    return out


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and the distance to it."""
    gaps = distances(values, entries)
    at = gaps.argmin(1)
    return at, gaps[np.arange(len(at)), at]


def reassigned(
    values: np.ndarray, entries: np.ndarray, moved: np.ndarray, codes: np.ndarray, dists: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of one part of many vectors, from those of the round before.

    ``codes`` and ``dists`` are the entries before and the distances to where they stood; ``moved`` marks the entries
    that have moved since.
    """
    codes, dists = codes.astype(np.int64), dists.copy()
    if not moved.any():
        return codes, dists
    stale = moved[codes]
    rescan = np.flatnonzero(stale)
    fixed = np.flatnonzero(~stale)
    active = np.flatnonzero(moved)
    at, gaps = nearest(values[fixed], entries[active])
    if len(fixed):
        at = active[at]
        better = (gaps < dists[fixed]) | ((gaps == dists[fixed]) & (at < codes[fixed]))
        codes[fixed[better]], dists[fixed[better]] = at[better], gaps[better]
    codes[rescan], dists[rescan] = nearest(values[rescan], entries)
    return codes, dists


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _round(book: np.ndarray, moved: np.ndarray, dims: int, sums: bool):
    """A task's part of a round: assign all parts, and sum them up by entry for the next codebook."""
    parts, n_entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                n = batch.num_rows
                values = _matrix(batch.column("values"), dims).astype(np.int64).reshape(n, parts, width)
                before = "codes" in batch.schema.names
                if before:
                    old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
                    old_dists = _matrix(batch.column("dists"), parts)
                codes, dists = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
                totals = np.zeros((parts, n_entries, width + 1), np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(values[:, p])
                    if before:
                        codes[:, p], dists[:, p] = reassigned(own, book[p], moved[p], old[:, p], old_dists[:, p])
                    else:
                        codes[:, p], dists[:, p] = nearest(own, book[p])
                    if sums:
                        order = np.argsort(codes[:, p], kind="stable")
                        used, first, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
                        totals[p, used, :width] = np.add.reduceat(own[order], first, axis=0)
                        totals[p, used, width] = counts
                offsets = np.arange(n + 1, dtype=np.int32)
                cells = totals.ravel()
                # The first row of a chunk carries the chunk's sums.
                ends = np.full(n + 1, len(cells) if sums else 0, np.int32)
                ends[0] = 0
                mask = np.ones(n, bool)
                mask[0] = not sums
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        batch.column("label"),
                        batch.column("values"),
                        pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets * parts), pa.array(dists.ravel())),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(cells if sums else cells[:0]), mask=pa.array(mask)
                        ),
                    ],
                    names=["key", "label", "values", "codes", "dists", "sums"],
                )

    return run


def _moved_entries(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Entries after a round: the floor of the mean of each entry's parts; entries without parts stay.

    The driver gets one row per cell of the codebooks, whatever the number of vectors.
    """
    parts, n_entries, width = book.shape
    cells = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("cell", "v")).where("v <> 0")
    totals = np.zeros((parts, n_entries, width + 1), object)
    for row in cells.groupBy("cell").agg(F.expr("sum(cast(v AS decimal(38,0)))").alias("v")).collect():
        totals.ravel()[row.cell] = int(row.v)
    after = book.copy()
    for p in range(parts):
        for e in range(n_entries):
            if totals[p, e, width]:
                after[p, e] = [int(t) // int(totals[p, e, width]) for t in totals[p, e, :width]]
    return after


def vector_codes(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> Coded:
    """Codes of all usable vectors, and the codebooks trained on all of them.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal consecutive parts. Each codebook starts
    as that part of the ``entries`` vectors with the smallest keys (at most 256; all of them if there are fewer).
    Each of ``rounds`` rounds assigns every part to the nearest entry, by squared Euclidean distance, and then
    moves every entry to the floored mean of its parts; finally parts are assigned again.

    ``rows`` has ``vec_key``, ``label``, ``code string`` (entry numbers in part order, two hex digits each) and ``error
    long`` (squared distances to the entries, summed over the parts).

    Rows whose vector is null or holds a null or non-finite component are left out. The vector with the smallest key
    sets the length: vectors of another length, or with components so large that distances pass 64 bits, take no part
    and come back with null code and error, as do all if the length is no multiple of ``parts``. Equal distances go
    to the lower index; of equal keys the smaller vector comes first; null keys come last; repeated rows each count.
    An empty table gives no rows and empty codebooks. Other columns are not read, whatever their names.

    Each round is a stored table, and the one before is removed; nothing is shuffled but the sums of the codebooks'
    cells.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be 1 to 256, parts at least 1, rounds at least 0")
    spark = vectors.sparkSession
    source = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = source.where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")
    order = [F.col("key").asc_nulls_last(), F.col("v").asc()]
    head = usable.orderBy(*order).limit(1).collect()
    dims = len(head[0].v) if head else 0
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("key", "label")}
    nothing = "key AS vec_key", "label", "cast(null AS string) AS code", "cast(null AS long) AS error"
    if not dims or dims % parts:
        return Coded(usable.selectExpr(*nothing), np.zeros((parts, 0, 0), np.int64))
    most = math.isqrt((1 << 62) // dims) // 2
    fits = f"size(v) = {dims} AND forall(v, x -> abs(x) * {scale}D < {most}D)"
    whole = usable.where(fits).selectExpr("key", "label", "v", f"transform(v, x -> int(floor(x * {scale}D))) AS values")
    first = whole.orderBy(*order).limit(entries).select("values").collect()
    if not first:
        return Coded(usable.selectExpr(*nothing), np.zeros((parts, 0, 0), np.int64))
    book = np.array([r["values"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    schema = f"key {kinds['key']}, label {kinds['label']}, values array<int>, codes binary, dists array<long>, sums array<long>"
    state, path, moved = whole.select("key", "label", "values"), None, np.ones(book.shape[:2], bool)
    for k in range(rounds + 1):
        last = k == rounds
        with small_batches(spark):
            there, after = store(state.drop("sums").mapInArrow(_round(book, moved, dims, not last), schema), "codes")
        if path:
            remove(spark, path)
        path, state = there, after
        if not last:
            before, book = book, _moved_entries(state, book)
            moved = (book != before).any(axis=2)
            if not moved.any():  # all later rounds would change nothing
                break
    rows = state.selectExpr(
        "key AS vec_key", "label", "lower(hex(codes)) AS code", "aggregate(dists, 0L, (s, d) -> s + d) AS error"
    )
    return Coded(rows.union(usable.where(f"NOT ({fits})").selectExpr(*nothing)), book)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error long``, the errors summed over the rows with the same label; nulls are one label.

    The sums are a stored table of one row per label, so a label with very many rows is summed up map-side.
    """
    rows = materialize(rows, "coded")
    sums = rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return rows.join(materialize(sums, "errors"), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")

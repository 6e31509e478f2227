"""Benchmark decontamination with a positional inverted index of the training texts.

The index is split by documents: a segment holds whole documents of about ``SEGMENT_BYTES`` of text, its
distinct terms, and for each term the ordered positions at which it stands. Positions count words through
the segment and skip ``GAP`` places between documents, so no match crosses two of them. Segments are rows of a
stored table; searching them needs no shuffle.

A phrase is found by intersecting the position lists of its terms, each moved back by the term's place in the
phrase, from the rarest term of the segment to the most frequent one. The proximity search is the same with
some slack around each place.

Terms are kept as 64-bit hashes of the lower-cased words (two different words share one with probability 2**-64).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import ALPHANUMERIC, Splitter, give_back, slices
from gradeloom.llm.stored import small_batches, store

SEGMENT_BYTES = 1 << 20
#: Bytes of a row group of the stored index.
ROW_GROUP_BYTES = 16 << 20
WINDOW = 10
#: Free positions between two documents of a segment; a search may not allow more slack.
GAP = 64
#: Words of test items that one pass over the index looks for; more items take more passes.
QUERY_WORDS = 1_000_000

SEGMENT_SCHEMA = (
    "segment long, doc_first array<long>, doc_words array<long>, terms binary, ends binary, positions binary"
)
MATCH_SCHEMA = "segment long, ordinal int, n_words long, items array<string>, spans array<struct<a:long,b:long>>"


class Segment(NamedTuple):
    """Terms in order, the number of positions up to each term's last one, and all positions."""

    terms: np.ndarray
    ends: np.ndarray
    positions: np.ndarray

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term - 1] if term else 0 : self.ends[term]]


def segment_of(hashes: np.ndarray, first: np.ndarray) -> tuple[Segment, np.ndarray]:
    """Inverted index of a block of documents, and the position of the first word of each."""
    words = np.diff(first)
    starts = first[:-1] + GAP * np.arange(len(words))
    places = np.arange(len(hashes)) + np.repeat(GAP * np.arange(len(words)), words)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.zeros(0, np.int64)
    return Segment(ordered[last], last + 1, places[order].astype(np.int32)), starts


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored index of all words of all texts: one row per segment, and its documents' keys in ``keys``.

    A document's ordinal in its segment is its place in ``keys``; null and repeated keys are kept as they are.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"{SEGMENT_SCHEMA}, keys array<{source.schema['key'].dataType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = Splitter(ALPHANUMERIC), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", SEGMENT_BYTES):
            words = split(batch.column("text"))
            segment, starts = segment_of(words.hash, words.first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([starts], pa.list_(pa.int64())),
                    pa.array([np.diff(words.first)], pa.list_(pa.int64())),
                    pa.array([segment.terms.astype("<u8").tobytes()], pa.binary()),
                    pa.array([segment.ends.astype("<i4").tobytes()], pa.binary()),
                    pa.array([segment.positions.astype("<i4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key")),
                ],
                names=["segment", "doc_first", "doc_words", "terms", "ends", "positions", "keys"],
            )
            number += 1

    with small_batches(docs.sparkSession):
        return store(source.mapInArrow(run, schema), "postings", ROW_GROUP_BYTES)[1]


class Queries:
    """Distinct windows of test items, by their length, and the items that hold each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.windows: dict[int, np.ndarray] = {}
        self.holders: dict[int, list[list[str]]] = {}
        found: dict[bytes, set[str]] = {}
        for item, words in items:
            for k in range(max(1, len(words) - window + 1)) if len(words) else ():
                found.setdefault(words[k : k + window].tobytes(), set()).add(item)
        every = [words for _, words in items if len(words)]
        #: Distinct terms; windows are rows of places in it, so a segment is searched once per term.
        self.terms = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        for size in {len(w) // 8 for w in found}:
            own = [w for w in found if len(w) == 8 * size]
            words = np.frombuffer(b"".join(own), np.uint64).reshape(-1, size)
            self.windows[size] = np.searchsorted(self.terms, words).astype(np.int32)
            self.holders[size] = [sorted(found[w]) for w in own]

    def matches(self, segment: Segment, slack: int = 0) -> Iterator[tuple[list[str], int, np.ndarray]]:
        """(items, window length, positions at which the window starts) of all windows that occur."""
        if not len(segment.terms) or not len(self.terms):
            return
        sizes = np.diff(segment.ends, prepend=0)
        at = np.minimum(np.searchsorted(segment.terms, self.terms), len(segment.terms) - 1)
        occurs = segment.terms[at] == self.terms
        for size, windows in self.windows.items():
            for k in np.flatnonzero(occurs[windows].all(axis=1)).tolist():
                terms = at[windows[k]]
                places = intersected(segment, terms, sizes[terms], slack)
                if len(places):
                    yield self.holders[size][k], size, places


def intersected(segment: Segment, terms: np.ndarray, sizes: np.ndarray, slack: int) -> np.ndarray:
    """Starts of a phrase: lists moved back by each term's offset and intersected, the shortest list first.

    With ``slack`` a term may stand up to that many places before or after its own.
    """
    order = np.argsort(sizes, kind="stable").tolist()
    starts = segment.list_of(terms[order[0]]).astype(np.int64) - order[0]
    if slack:
        starts = np.unique(starts[:, None] + np.arange(-slack, slack + 1))
    for k in order[1:]:
        if not len(starts):
            break
        places = segment.list_of(terms[k])
        nearest = np.searchsorted(places, starts + (k - slack))
        reached = nearest < len(places)
        starts, nearest = starts[reached], nearest[reached]
        starts = starts[places[nearest] <= starts + (k + slack)]
    return starts


def item_words(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Test items with the hashes of their words, in groups of about ``QUERY_WORDS`` words.

    The driver holds one group at a time. Items without an id or without words are left out; one item may
    stand in several rows.
    """
    source = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(ALPHANUMERIC)
        for batch in slices(batches, "text"):
            words = split(batch.column("text"))
            each = [words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(each, pa.binary())], names=["item", "words"])

    rows = source.where("item IS NOT NULL").mapInArrow(run, "item string, words binary").where("length(words) > 0")
    group, size = [], 0
    for row in rows.toLocalIterator():
        group.append((row.item, np.frombuffer(bytes(row.words), np.uint64)))
        size += len(row.words) // 8
        if size >= QUERY_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], np.append(reach[:-1][new[1:]], reach[-1])], axis=1)


def search(index: DataFrame, queries: Queries, slack: int = 0) -> DataFrame:
    """Documents with occurrences of the queries: their items and the merged spans of words, by document.

    Spans are half-open and count the document's words from 0. With ``slack`` (less than half of
    ``GAP``) each term of a window may stand so many places before or after its own: a proximity search. A match starts
    inside its document. Returns ``MATCH_SCHEMA``.
    """
    if not 0 <= slack < GAP // 2:
        raise ValueError(f"slack must be at least 0 and less than {GAP // 2}")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = (("terms", "<u8"), ("ends", "<i4"), ("positions", "<i4"))
                # Views of the batch: lists of a segment are not copied.
                segment = Segment(*(np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in parts))
                first, size = (batch.column(c)[k].values.to_numpy() for c in ("doc_first", "doc_words"))
                number = batch.column("segment")[k].as_py()
                items: dict[int, set[str]] = {}
                spans: dict[int, list[np.ndarray]] = {}
                for holders, length, places in queries.matches(segment, slack):
                    docs = np.maximum(np.searchsorted(first, places, "right") - 1, 0)
                    inside = (places >= first[docs]) & (places < first[docs] + size[docs])
                    places, docs = places[inside], docs[inside]
                    for doc in np.unique(docs).tolist():
                        own = places[docs == doc] - first[doc]
                        # A near match may reach over the document's end.
                        own = np.stack([own, np.minimum(own + length, size[doc])], axis=1)
                        items.setdefault(doc, set()).update(holders)
                        spans.setdefault(doc, []).append(own)
                out = [
                    {
                        "segment": number,
                        "ordinal": doc,
                        "n_words": int(size[doc]),
                        "items": sorted(items[doc]),
                        "spans": [{"a": a, "b": b} for a, b in merged_spans(np.concatenate(spans[doc])).tolist()],
                    }
                    for doc in sorted(items)
                ]
                if out:
                    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(span)]
                    names = ["segment", "ordinal", "n_words", "items", "spans"]
                    yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, kinds))))
        give_back()

    return index.select("segment", "doc_first", "doc_words", "terms", "ends", "positions").mapInArrow(run, MATCH_SCHEMA)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slack: int = 0,
) -> DataFrame:
    """For each row of ``docs`` the words that lie in windows of test items.

    Returns ``doc_key`` (the value of ``key``), ``n_words long``, ``n_hit long`` (words inside an occurrence),
    ``n_items long``, ``items array<string>`` (sorted ids of items with an occurring window), ``spans`` (merged
    half-open word spans) and ``contaminated boolean``. A window has ``window`` words; an item of fewer words is one
    window. Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.

    Null and empty texts have no words; items without an id or words are ignored; repeated rows, null and repeated
    keys give a row each; an empty ``docs`` gives no rows. Other columns are not read, whatever their names.

    The texts are read once and the index is stored once; each group of ``QUERY_WORDS`` words of test items then
    reads the index and stores its matches, so the driver holds the words of one group. Only matching documents are
    shuffled. A task holds the segments of one Arrow batch.
    """
    index = build_index(docs, key, text)
    found = []
    for group in item_words(benchmark, item, item_text):
        with small_batches(docs.sparkSession):
            found.append(store(search(index, Queries(group, window), slack), "matches")[1])
    rows = index.selectExpr("segment", "posexplode(arrays_zip(keys, doc_words)) AS (ordinal, doc)").selectExpr(
        "segment", "ordinal", "doc.keys AS doc_key", "doc.doc_words AS n_words"
    )
    if not found:
        return rows.selectExpr(
            "doc_key", "n_words", "0L AS n_hit", "0L AS n_items", "cast(array() AS array<string>) AS items",
            "cast(array() AS array<struct<a:bigint,b:bigint>>) AS spans", "false AS contaminated",
        )
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("segment", "ordinal").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # Spans of several passes may overlap again: a left-to-right sweep joins them.
    sweep = """aggregate(spans, cast(array() AS array<struct<a:bigint,b:bigint>>), (done, s) ->
        IF(size(done) > 0 AND s.a <= element_at(done, -1).b,
           concat(slice(done, 1, size(done) - 1),
                  array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, s.b)))),
           concat(done, array(s))))"""
    hits = hits.withColumn("spans", F.expr(sweep)) if len(found) > 1 else hits
    return rows.join(hits, ["segment", "ordinal"], "left").selectExpr(
        "doc_key",
        "n_words",
        "coalesce(aggregate(spans, 0L, (n, s) -> n + s.b - s.a), 0L) AS n_hit",
        "coalesce(cast(size(items) AS long), 0L) AS n_items",
        "coalesce(items, cast(array() AS array<string>)) AS items",
        "coalesce(spans, cast(array() AS array<struct<a:bigint,b:bigint>>)) AS spans",
        "items IS NOT NULL AS contaminated",
    )

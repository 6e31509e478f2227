"""Phrase collocations by set-oriented mining (SETM): occurrence relations, merge-joined and counted length by length.

The occurrences of all phrases of one length are a stored relation, sorted by piece and position. The next length
comes from three steps, as in Houtsma and Swami (1995): count the groups, semi-join the relation with the frequent
ones, and merge-join what is left with itself at adjacent positions of the same piece. A phrase cannot be
more frequent than a part of it, so nothing is lost.

The relation is stored in runs, each the occurrences of one language in some whole documents: the distance from
one occurrence's place to the next, the number of its phrase in the run, and the run's phrases with their counts. Places
count words and skip one between pieces, so two adjacent places always lie in one piece. A merge-join reads one run.

To be counted, the phrases of each run are dealt to parts by a hash; a part adds up its phrases of all runs and answers
each run which of them are frequent. There are so many parts that each has about ``PART_PHRASES`` to count. A frequent phrase
gets a number, and a longer one is known by the number of its head (all words but the last) and that of its last
word, so words move as text only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.blocks import _LOWER, SpanHasher, mix, slices, text_bytes
from gradeloom.llm.stored import remove, small_batches, store
from gradeloom.sources.shared import materialize

#: Text of one language that makes a run; a longer text is a run of its own.
RUN_BYTES = 4 << 20
#: Texts that a task holds for runs not yet full, in runs; beyond that the largest is closed early.
OPEN_RUNS = 6
#: Phrases of all runs that a part counts, about.
PART_PHRASES = 500_000
#: Lots of a language's phrases that are ranked on their own first.
RANK_LOTS = 64
#: Bytes of a row group of the stored relations.
ROW_GROUP_BYTES = 16 << 20
#: Numbers are packed into ``binary`` columns, see ``packed``; words are joined by spaces.
WORD_SCHEMA = "run long, size long, n long, lang string, steps binary, codes binary, words string, counts binary"
PHRASE_SCHEMA = "run long, size long, steps binary, codes binary, heads binary, lasts binary, counts binary"
WORD_CHUNKS = "part long, run long, lang string, codes binary, words string, counts binary"
PHRASE_CHUNKS = "part long, run long, codes binary, heads binary, lasts binary, counts binary"
#: Answers to runs (``run, codes, ids, lasts``), and rows of frequent phrases without a run.
WORD_ANSWERS = "run long, codes binary, ids binary, lasts binary, id long, f long, lang string, phrase string"
PHRASE_ANSWERS = "run long, codes binary, ids binary, lasts binary, id long, f long, head long, last long"

#: Bytes that end pieces, and bytes of words: neither those nor blanks.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~ENDS
WORD[[ord(" "), ord("\t")]] = False


def word_places(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of all texts in order, and their places; a place is skipped between pieces and texts."""
    data, offsets = text_bytes(column)
    if not len(data):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    inside = WORD[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    starts = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate(([False], inside[:-1]))))
    stops = np.flatnonzero(inside & (edges[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    letters = np.ascontiguousarray(_LOWER[data[inside]])
    bounds = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters))
    # Ends of pieces and edges of texts before each word.
    breaks = np.cumsum(ENDS[data], dtype=np.int32)[starts] + np.searchsorted(offsets, starts, "right")
    new_piece = np.concatenate(([False], breaks[1:] != breaks[:-1]))
    return words.dictionary_encode(), np.arange(len(starts)) + np.cumsum(new_piece)


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, byte by byte of all values: high bytes, which are mostly
    alike, compress well. The first byte is the width."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 3, 4, 8) if top < 1 << 8 * w)
    cells = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + cells.T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields]
    )


def _steps(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=0))


def _read(batch: pa.RecordBatch, k: int, *columns: str) -> list[np.ndarray]:
    return [unpacked(batch.column(c)[k].as_py()) for c in columns]


def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence relation of the words, from batches of ``lang, text``."""
    number = TaskContext.get().partitionId() << 32
    open_texts: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def closed(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        size.pop(lang)
        words, places = word_places(pa.concat_arrays(open_texts.pop(lang)))
        if len(places):
            codes, distinct = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
            counts = np.bincount(codes, minlength=len(distinct))
            numbers = _steps(places), packed(codes), " ".join(distinct), packed(counts)
            yield _batch(WORD_SCHEMA, [(number, len(distinct), len(places), lang, *numbers)])
            number += 1

    for batch in slices(batches, "text"):
        langs = batch.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").take(pa.array(np.flatnonzero(which == k)))
            n = int(text_bytes(texts)[1][-1])
            if size.get(lang, 0) + n > RUN_BYTES and lang in size:
                yield from closed(lang)
            open_texts.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + n
        while sum(size.values()) > OPEN_RUNS * RUN_BYTES:
            yield from closed(max(size, key=size.__getitem__))
    for lang in list(size):
        yield from closed(lang)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each part, in order."""
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(bounds, [*bounds[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


def _word_chunks(parts: int):
    """Words of each run, dealt to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            for k in range(batch.num_rows):
                number, lang, text = (batch.column(c)[k].as_py() for c in ("run", "lang", "words"))
                (counts,) = _read(batch, k, "counts")
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.append(np.flatnonzero(data == 32), len(data))
                hashes = hasher(data, np.append(0, ends[:-1] + 1), ends)
                words = np.array(text.split(" "), object)
                rows = []
                for part, at in _dealt((hashes % np.uint64(parts)).astype(np.int64)):
                    rows.append((part, number, lang, _steps(at), " ".join(words[at].tolist()), packed(counts[at])))
                yield _batch(WORD_CHUNKS, rows)

    return run


def _phrase_chunks(parts: int):
    """Longer phrases of each run, dealt to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("run")[k].as_py()
                steps, lasts, counts = _read(batch, k, "heads", "lasts", "counts")
                heads = np.cumsum(steps)
                hashes = mix(mix(heads.astype(np.uint64)) + lasts.astype(np.uint64))
                rows = []
                for part, at in _dealt((hashes % np.uint64(parts)).astype(np.int64)):
                    rows.append((part, number, _steps(at), _steps(heads[at]), packed(lasts[at]), packed(counts[at])))
                yield _batch(PHRASE_CHUNKS, rows)

    return run


def _sums(which: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, which, counts)
    return out


def _answers(schema: str, runs: list[int], codes: list[np.ndarray], found: np.ndarray, lasts: np.ndarray | None) -> list[tuple]:
    """Rows for the runs: their frequent phrases, with the ids ``found`` (-1 for others) and those of the last words."""
    rows, at = [], 0
    nothing = (None,) * (len(schema.split(", ")) - 4)
    for number, own in zip(runs, codes):
        ids = found[at : at + len(own)]
        some = np.flatnonzero(ids >= 0)
        if len(some):
            last = ids if lasts is None else lasts[at : at + len(own)]
            rows.append((number, packed(own[some]), packed(ids[some]), packed(last[some]), *nothing))
        at += len(own)
    return rows


def _count_words(least: int, parts: int):
    def run(chunks: pa.Table) -> pa.Table:
        part = chunks.column("part")[0].as_py()
        out, next_id = [], 0
        langs = chunks.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = chunks.filter(pa.array([x == lang for x in langs])).to_pylist()
            words = pa.array([w for c in own for w in c["words"].split(" ")], pa.string()).dictionary_encode()
            which, distinct = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            f = _sums(which, np.concatenate([unpacked(c["counts"]) for c in own]), len(distinct))
            frequent = np.flatnonzero(f >= least)
            ids = np.full(len(distinct), -1)
            ids[frequent] = (next_id + np.arange(len(frequent))) * parts + part
            next_id += len(frequent)
            codes = [np.cumsum(unpacked(c["codes"])) for c in own]
            out += _answers(WORD_ANSWERS, [c["run"] for c in own], codes, ids[which], None)
            names = distinct.take(pa.array(frequent)).to_pylist()
            out += [(None, None, None, None, i, n, lang, w) for i, n, w in zip(ids[frequent].tolist(), f[frequent].tolist(), names)]
        return pa.Table.from_batches([_batch(WORD_ANSWERS, out)])

    return run


def _numbered(heads: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct pair, and the number of each row's pair."""
    if max(heads.max(initial=0), lasts.max(initial=0)) < 1 << 31:
        pairs = heads << 32 | lasts
    else:
        pairs = np.rec.fromarrays([heads, lasts])
    return np.unique(pairs, return_index=True, return_inverse=True)[1:]


def _count_phrases(least: int, parts: int, answer: bool):
    def run(chunks: pa.Table) -> pa.Table:
        part, own = chunks.column("part")[0].as_py(), chunks.to_pylist()
        heads = np.concatenate([np.cumsum(unpacked(c["heads"])) for c in own])
        lasts, counts = (np.concatenate([unpacked(c[x]) for c in own]) for x in ("lasts", "counts"))
        first, which = _numbered(heads, lasts)
        f = _sums(which, counts, len(first))
        frequent = np.flatnonzero(f >= least)
        ids = np.full(len(first), -1)
        ids[frequent] = np.arange(len(frequent)) * parts + part
        out = []
        if answer:
            codes = [np.cumsum(unpacked(c["codes"])) for c in own]
            out = _answers(PHRASE_ANSWERS, [c["run"] for c in own], codes, ids[which], lasts)
        at = first[frequent]
        columns = (x.tolist() for x in (ids[frequent], f[frequent], heads[at], lasts[at]))
        out += [(None, None, None, None, *row) for row in zip(*columns)]
        return pa.Table.from_batches([_batch(PHRASE_ANSWERS, out)])

    return run


def merge_join(
    places: np.ndarray, codes: np.ndarray, kept: np.ndarray, ids: np.ndarray, last_ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences that are a word longer: places, numbers of phrases, and each phrase's head, last word and count.

    ``kept`` has the numbers of the frequent phrases in the run, ``ids`` (ascending) and ``last_ids`` their ids and those
    of their last words.
    """
    place_of = np.full(int(codes.max(initial=-1)) + 1, -1)
    place_of[kept] = np.arange(len(kept))
    at = place_of[codes]
    places, at = places[at >= 0], at[at >= 0]  # the semi-join
    adjacent = np.flatnonzero(places[1:] == places[:-1] + 1)
    pairs = at[adjacent] * len(kept) + at[adjacent + 1]
    distinct, joined, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    first, second = np.divmod(distinct, max(1, len(kept)))
    return places[adjacent], joined, ids[first], last_ids[second], counts


def longer_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relation of the phrases that are a word longer, from runs with the answers they got in ``keep``."""
    for batch in batches:
        for k in range(batch.num_rows):
            steps, codes = _read(batch, k, "steps", "codes")
            answers = batch.column("keep")[k].as_py()
            kept, ids, last_ids = (np.concatenate([unpacked(a[c]) for a in answers]) for c in ("codes", "ids", "lasts"))
            order = np.argsort(ids)
            joined = merge_join(np.cumsum(steps), codes, kept[order], ids[order], last_ids[order])
            places, numbers, heads, lasts, counts = joined
            if len(places):
                run = batch.column("run")[k].as_py()
                row = run, len(heads), _steps(places), packed(numbers), _steps(heads), packed(lasts), packed(counts)
                yield _batch(PHRASE_SCHEMA, [row])


def _counted(runs: DataFrame, least: int, first: bool, answer: bool) -> tuple[str, DataFrame]:
    """Stored answers to the runs and frequent phrases: group and count."""
    total = runs.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // PART_PHRASES))
    if first:
        chunks = runs.select("run", "lang", "words", "counts").mapInArrow(_word_chunks(parts), WORD_CHUNKS)
        answers = chunks.groupBy("part").applyInArrow(_count_words(least, parts), WORD_ANSWERS)
    else:
        chunks = runs.select("run", "heads", "lasts", "counts").mapInArrow(_phrase_chunks(parts), PHRASE_CHUNKS)
        answers = chunks.groupBy("part").applyInArrow(_count_phrases(least, parts, answer), PHRASE_ANSWERS)
    with small_batches(runs.sparkSession):
        return store(answers, "answers", ROW_GROUP_BYTES)


def _extended(runs: DataFrame, answers: DataFrame) -> tuple[str, DataFrame]:
    """Stored relation of the next length: semi-join with the frequent groups, then merge-join, run by run.

    A run's answers are no more than its phrases.
    """
    keep = answers.where("run IS NOT NULL").groupBy("run").agg(F.collect_list(F.struct("codes", "ids", "lasts")).alias("keep"))
    joined = runs.select("run", "steps", "codes").join(keep, "run")
    with small_batches(runs.sparkSession):
        return store(joined.mapInArrow(longer_runs, PHRASE_SCHEMA), "phrases", ROW_GROUP_BYTES)


def _part(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 3,
    min_count: int = 10,
    contained_percent: int = 50,
    top: int | None = 2000,
) -> DataFrame:
    """Phrases of 2 to ``max_words`` words that occur more often than their parts let expect, by language.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and those into words at
    spaces and tabs. Candidates have ``min_count`` occurrences ``a`` or more, overlapping ones included. Cut after a
    word, a candidate has parts with ``l`` and ``r`` occurrences and the score ``floor(1000000 * a * a / (l * r))``; the
    lowest-scoring cut counts, of equal ones the first. A candidate goes if a longer one (kept or not) contains it and
    has ``contained_percent`` of its occurrences or more.

    Returns ``lang, rank, phrase, a, l, r, n, score``; ``n`` counts all words of the language and ``rank`` orders by
    score and ``a``, descending, then by the phrase's bytes: no ties. ``top`` limits the ranks; None returns all.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; an empty table gives no
    rows; other columns are not read, whatever their names. Words and texts of any length stay whole.

    Products are exact decimals (up to ``a`` = 10**15). A task holds one run, ``OPEN_RUNS`` runs of
    text, or one part. Parts of a frequent phrase are frequent, so joins with the frequent groups lose nothing.
    """
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")
    )
    spark = docs.sparkSession
    with small_batches(spark):
        path, runs = store(source.mapInArrow(word_runs, WORD_SCHEMA), "word-runs", ROW_GROUP_BYTES)
    words = materialize(runs.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    answers_path, answers = _counted(runs, min_count, first=True, answer=True)
    found = {1: materialize(answers.where("run IS NULL").select("id", "lang", "phrase", "f"), "frequent")}
    for k in range(2, max_words + 1):
        before = path, answers_path
        path, runs = _extended(runs, answers)
        for old in before:
            remove(spark, old)
        answers_path, answers = _counted(runs, min_count, first=False, answer=k < max_words)
        heads = found[k - 1].selectExpr("id AS head", "lang", "phrase AS start")
        ends = found[1].selectExpr("id AS last", "phrase AS word")
        named = answers.where("run IS NULL").select("id", "head", "last", "f").join(heads, "head").join(ends, "last")
        found[k] = materialize(named.selectExpr("id", "lang", "concat(start, ' ', word) AS phrase", "f"), "frequent")
    for old in path, answers_path:
        remove(spark, old)
    found = {k: f.drop("id") for k, f in found.items()}

    parts, candidates = found[1], found[2].withColumn("k", F.lit(2))
    for k in range(2, max_words):
        parts = parts.unionByName(found[k])
        candidates = candidates.unionByName(found[k + 1].withColumn("k", F.lit(k + 1)))
    candidates = candidates.withColumn("w", F.split("phrase", " ", -1)).withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.expr(_part("w", "1", "cut")).alias("head"), F.expr(_part("w", "cut + 1", "k - cut")).alias("rest")
    )
    left = parts.selectExpr("lang", "phrase AS head", "f AS l")
    right = parts.selectExpr("lang", "phrase AS rest", "f AS r")
    ratio = "1000000 * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) DIV (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(ratio))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    if max_words > 2:
        inner = candidates.where("k > 2").select(
            "lang", "a", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")
        )
        inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
        inner = inner.selectExpr("lang", _part("w", "at", "m") + " AS phrase", "a AS longer")
        inside = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(inside, ["lang", "phrase"], "left")
        best = best.where(f"longer IS NULL OR 100 * longer < {contained_percent} * a").drop("longer")
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    if top is not None:
        # The first of each lot hold the first of all, so one task ranks no more than RANK_LOTS * top rows.
        lot = F.pmod(F.xxhash64("phrase"), F.lit(RANK_LOTS))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", lot).orderBy(*order)))
        best = best.where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

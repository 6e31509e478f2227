"""Exact Jaccard self-join of documents on word n-grams, down to groups of linked documents.

Documents with equal sets are one node. Two sets that are similar enough share one of their first shingles in
any fixed order (the prefix), so nodes are dealt into tiles: one for each shared prefix shingle and band of
set sizes, cut into blocks when many nodes share the shingle. In a tile, hashed parity bitmaps give an upper
bound of the overlap by counting differing bits; only pairs within the bound are intersected exactly, as sorted
arrays. Shingles that very many documents share come last in the order, so they rarely deal tiles.

With a prefix longer by m shingles, similar sets share m + 1 of them. So a node stands in tiles only if enough of
its prefix occurs elsewhere: sharing a line or a passage with other texts is not enough.

Groups do not need all pairs: a first round compares each node with the leaders of a few of its tiles. In tiles that
still hold many groups, further rounds compare a leader of each group with its nearest other groups. A last one compares, in all tiles, the
nodes that are still in different groups. So every link between different groups is found, and a group of n near copies
costs about n comparisons.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.blocks import NOT_BLANK, Splitter, give_back, mix, shingles, slices
from gradeloom.llm.components import connected_components
from gradeloom.llm.stored import small_batches
from gradeloom.sources.shared import materialize

#: Shingles that are put last in the order. They only settle the order: any list gives the same result.
LAST_SHINGLES = 20_000
#: Rounds of leaders between groups, and groups in a tile from which on they take it. They only save pairs in the last
#: round; a round that finds fewer links than that is the last of them.
GROUP_ROUNDS = 3
MANY_GROUPS = 8
#: Other groups that a leader of a group takes a node of.
BEST_GROUPS = 4
#: Nodes of a block of a tile.
TILE_NODES = 2_048
#: Tiles in which a node meets leaders in the first round; the second round takes all its tiles.
FIRST_TILES = 6
#: The prefix is longer by this part of the set.
FURTHER_PART = 20
#: Bits of the filter for nodes that need their whole set; false positives are joined away.
FILTER_BITS = 1 << 23
#: Bits of a bitmap for each shingle, at least.
BITS_PER_SHINGLE = 2


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which a similar set has at least one among its own prefix."""
    return n - -(-percent * n // 100) + 1 if n else 0


def further(n: int) -> int:
    """Shingles by which the prefix of a set of ``n`` is longer; a similar set shares as many more, counted by the
    smaller of the two sets."""
    return n // FURTHER_PART


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap(own: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod width is flipped by every shingle h; the width is a power of two."""
    width = max(64, 1 << (BITS_PER_SHINGLE * len(own) - 1).bit_length())
    bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width, that of the narrowest: halves laid over each other keep the parity."""
    width = min(map(len, bitmaps)) // 8
    rows = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bitmaps]
    return np.stack(rows)


def within_bound(sizes: np.ndarray, bits: np.ndarray, k: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` may be similar to node ``k``: differing bits bound the shingles that differ."""
    differing = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
    return others[(100 - percent) * (sizes[others] + sizes[k]) >= (100 + percent) * differing]


def leader_pairs(
    nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int, groups: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Each node with the first leader it may be similar to; a node without one is a leader. Every node is a group.

    Nodes come in the order of their numbers, so the tiles of a group mostly have the same leaders.
    """
    left, out = np.argsort(nodes, kind="stable"), []
    while len(left) > 1:
        near = within_bound(sizes, bits, left[0], left[1:], percent)
        out += [(int(nodes[left[0]]), int(nodes[k])) for k in near]
        left = left[1:][~np.isin(left[1:], near, assume_unique=True)]
    return out


def group_pairs(
    nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int, groups: np.ndarray, turn: int = 0
) -> list[tuple[int, int]]:
    """A leader of each group with the nearest node of each of the ``BEST_GROUPS`` nearest other groups, as far as they
    may be similar. Every ``turn`` has other leaders, the same in all tiles."""
    order = np.argsort(mix(nodes.astype(np.uint64) + np.uint64(turn << 56)), kind="stable")
    leaders, out = order[np.unique(groups[order], return_index=True)[1]], []
    for k in leaders.tolist():
        others = np.flatnonzero(groups != groups[k])
        differing = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
        spare = (100 - percent) * (sizes[others] + sizes[k]) - (100 + percent) * differing
        near = np.argsort(-spare, kind="stable")[: int((spare >= 0).sum())]
        first = np.sort(np.unique(groups[others[near]], return_index=True)[1])[:BEST_GROUPS]
        out += [(int(nodes[k]), int(nodes[others[near[j]]])) for j in first]
    return out


def cross_pairs(
    nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int, groups: np.ndarray
) -> list[tuple[int, int]]:
    """All pairs of nodes of different groups that may be similar."""
    out = []
    for k in range(len(nodes) - 1):
        others = np.flatnonzero(groups[k + 1 :] != groups[k]) + k + 1
        out += [(int(nodes[k]), int(nodes[o])) for o in within_bound(sizes, bits, k, others, percent)]
    return out


def _frequent_shingles(source: DataFrame, width: int) -> np.ndarray:
    """The most common shingles, by the documents of all blocks in which they are common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(NOT_BLANK)
        for batch in slices(batches, "text"):
            each = [s for s in shingles(split(batch.column("text")), width) if len(s)]
            if each:
                found, counts = np.unique(np.concatenate(each), return_counts=True)
                common = counts >= max(8, len(each) // 500)
                columns = [pa.array(found[common].view(np.int64)), pa.array(counts[common].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "n"])

    rows = source.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "shingle").limit(LAST_SHINGLES).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in top], np.int64).view(np.uint64))


def _sets(source: DataFrame, width: int, percent: int) -> DataFrame:
    """Stored table of all documents: row number, key, set size, fingerprint, and the prefix of the first
    document of a task with that set (``first`` is its row number)."""
    last = _frequent_shingles(source, width)
    key = source.schema["key"].dataType.simpleString()
    schema = f"row long, key {key}, n long, hi long, lo long, first long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row, seen = Splitter(NOT_BLANK), TaskContext.get().partitionId() << 33, {}
        for batch in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("row", "n", "hi", "lo", "first", "prefix")}
            for own in shingles(split(batch.column("text")), width):
                print_, prefix = fingerprint(own), None
                if print_ not in seen:
                    seen[print_] = row
                    if len(own):
                        late = np.isin(own, last, assume_unique=True)
                        prefix = np.concatenate([own[~late], own[late]])[: prefix_length(len(own), percent) + further(len(own))].view(np.int64)
                for c, v in zip(out, (row, len(own), *print_, seen[print_], prefix)):
                    out[c].append(v)
                row += 1
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            columns = {c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)} | {"key": batch.column("key")}
            names = ["row", "key", "n", "hi", "lo", "first", "prefix"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return materialize(source.mapInArrow(run, schema), "sets")


def _whole_sets(source: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Stored ``node, n, shingles, bits`` of the given nodes (``node, hi, lo``), from a second pass over the texts."""
    bucket = f"pmod(lo, {FILTER_BITS}L) + 1"
    parts = (
        nodes.selectExpr(f"bitmap_bucket_number({bucket}) AS k", f"bitmap_bit_position({bucket}) AS p")
        .groupBy("k")
        .agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)  # of a fixed size, whatever the number of nodes
    for part in parts.collect():
        at = (part.k - 1) * len(part.bits)
        bits[at : at + len(part.bits)] = np.frombuffer(bytes(part.bits), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, wanted = Splitter(NOT_BLANK), set(), np.unpackbits(bits, bitorder="little")
        for batch in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("hi", "lo", "n", "shingles", "bits")}
            for own in shingles(split(batch.column("text")), width):
                hi, lo = fingerprint(own)
                if len(own) and (hi, lo) not in seen and wanted[lo % FILTER_BITS]:
                    seen.add((hi, lo))
                    for c, v in zip(out, (hi, lo, len(own), own.tobytes(), bitmap(own))):
                        out[c].append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    found = source.select("text").mapInArrow(run, "hi long, lo long, n long, shingles binary, bits binary")
    # Copies from several tasks go by the keys of the join, so they need no shuffle of their own.
    whole = found.join(nodes, ["hi", "lo"]).dropDuplicates(["hi", "lo"]).select("node", "n", "shingles", "bits")
    return materialize(whole, "whole_sets")


def _tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if held and tuple(key[x]) != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(x, y - x))
            last = tuple(key[x])
    if held:
        yield pa.concat_tables(held)


def _candidates(tiles: DataFrame, whole: DataFrame, percent: int, pairs_of: Callable) -> DataFrame:
    """Distinct pairs ``a, b`` of nodes of different groups that share a tile and stay within the bound, as ``pairs_of`` picks them."""
    base = math.log(100 / (percent - 0.1))
    rows = tiles.join(whole.select("node", "n", "bits"), "node")
    rows = rows.withColumn("band", F.expr(f"floor(ln(n) / {base!r}D)"))
    rows = rows.withColumn("blocks", F.expr(f"cast(ceil(df / {TILE_NODES}) AS long)"))
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumn("level", F.explode(F.expr("array(band, band - 1)")))
    keys = ["shingle", "level", "low", "high"]
    rows = rows.selectExpr(
        "shingle", "level", "least(block, other) AS low", "greatest(block, other) AS high", "node", "n", "bits", "grp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, keys):
            nodes, sizes, groups = (tile.column(c).to_numpy() for c in ("node", "n", "grp"))
            if (groups == groups[0]).all():
                continue
            bits = folded(tile.column("bits").to_pylist())
            pairs = pairs_of(nodes, sizes, bits, percent, groups)
            ends = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])
        give_back()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, by exact intersection."""
    a = whole.selectExpr("node AS a", "shingles AS a_set")
    b = whole.selectExpr("node AS b", "shingles AS b_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The group of each row of ``docs`` under links of similarity ``percent`` / 100 or more.

    Returns ``doc_key`` (the value of ``key``), ``n_shingles long`` (size of its set) and ``group_key``, the smallest
    key reachable by links, its own included. A set holds the distinct runs of ``width`` words, lower-cased in A-Z;
    a shorter text is one run. Null, empty and blank texts have an empty set and link with nothing. Rows with equal
    sets link, repeated rows too; a null key never names a group of others, and a group of null keys has the name
    null. An empty input gives no rows. Other columns are not read, whatever their names.

    Shingles are 64-bit hashes, whole sets are told apart by 128 bits. The texts are read three times: for common
    shingles, for prefixes, and for the sets of nodes in tiles. Prefixes are shuffled once; whole sets move only for
    nodes in tiles and their pairs. The driver holds ``LAST_SHINGLES`` numbers and ``FILTER_BITS`` bits.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be within 50 and 100")
    with small_batches(docs.sparkSession):
        return _groups(docs, key, text, width, percent)


def _groups(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sets = _sets(source, width, percent)
    firsts = sets.where("prefix IS NOT NULL")
    same = firsts.groupBy("hi", "lo").agg(F.min("row").alias("node"))
    named = materialize(firsts.join(same, ["hi", "lo"]).select("row", "node", "hi", "lo", "n"), "nodes")

    dealt = firsts.select("row", F.posexplode("prefix").alias("place", "shingle"))
    dealt = dealt.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1").drop("df")
    dealt = dealt.join(named.select("row", "node", "n"), "row").dropDuplicates(["shingle", "node"]).drop("row")
    dealt = materialize(dealt, "dealt")
    # A shingle counts for a node if another node has it; similar sets share further(n) + 1 or more.
    smaller = f"-floor(-{percent} * n / 100)"
    enough = f"count(*) > floor(({smaller}) / {FURTHER_PART})"
    shared = dealt.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1").select("shingle")
    shared = dealt.join(shared, "shingle").groupBy("node", "n").agg(F.expr(enough).alias("enough")).where("enough")
    first = f"place < n + floor(-{percent} * n / 100) + 1"
    dealt = materialize(dealt.join(shared.select("node"), "node").where(first).select("shingle", "node"), "dealt")
    # Tiles of the same nodes are one tile, and a tile of two nodes is a pair.
    sums = F.count("*").alias("df"), F.expr("bit_xor(xxhash64(node))").alias("s"), F.expr("bit_xor(hash(node, node))").alias("t")
    ends = F.min("node").alias("a"), F.max("node").alias("b")
    tiles = dealt.groupBy("shingle").agg(*sums, *ends).where("df > 1")
    tiles = materialize(tiles.groupBy("df", "s", "t", "a", "b").agg(F.min("shingle").alias("shingle")), "kinds")
    twos = tiles.where("df = 2").select("a", "b")
    tiles = materialize(dealt.join(tiles.where("df > 2").select("shingle", "df"), "shingle"), "tiles")

    inside = tiles.select("node").union(twos.select("a")).union(twos.select("b")).distinct()
    inside = inside.join(named.where("row = node"), "node").select("node", "hi", "lo")
    whole = _whole_sets(source, materialize(inside, "inside"), width)

    place = F.row_number().over(Window.partitionBy("node").orderBy("shingle"))
    some = tiles.withColumn("place", place).where(f"place <= {FIRST_TILES}").drop("place")
    first_pairs = _candidates(some.withColumn("grp", F.col("node")), whole, percent, leader_pairs)
    first_pairs = materialize(first_pairs.union(twos).distinct(), "pairs")
    links = materialize(_verified(first_pairs, whole, percent), "links")
    groups = materialize(connected_components(links), "groups")

    done, turn = first_pairs, 0
    while True:
        turn += 1
        between = turn <= GROUP_ROUNDS
        pairs_of, least = (partial(group_pairs, turn=turn), MANY_GROUPS) if between else (cross_pairs, 2)
        marked = tiles.join(groups, "node", "left").selectExpr("shingle", "node", "df", "coalesce(component, node) AS grp")
        marked = materialize(marked, "marked")
        ends = F.min("grp").alias("x"), F.max("grp").alias("y"), F.approx_count_distinct("grp").alias("g")
        mixed = marked.groupBy("shingle").agg(*ends).where(f"x < y AND (g >= {least} OR {least} = 2)")
        rest = marked.join(mixed.select("shingle"), "shingle", "left_semi")
        more = materialize(_candidates(rest, whole, percent, pairs_of), "pairs").join(done, ["a", "b"], "left_anti")
        more = materialize(more, "pairs")
        done = done.union(more)
        found = materialize(_verified(more, whole, percent), "links")
        links = links.union(found)
        n_found = found.count()
        if n_found:
            groups = materialize(connected_components(links), "groups")
        if not between:
            break
        if n_found < MANY_GROUPS:
            turn = GROUP_ROUNDS

    nodes = named.join(groups, "node", "left").selectExpr("row AS first", "coalesce(component, node) AS grp")
    rows = sets.select("row", "key", "n", "first").join(nodes, "first", "left")
    rows = materialize(rows.selectExpr("key", "n", "if(n = 0, row, grp) AS grp"), "rows")
    smallest = rows.groupBy("grp").agg(F.min("key").alias("group_key"))
    return rows.join(smallest, "grp").selectExpr("key AS doc_key", "n AS n_shingles", "group_key")

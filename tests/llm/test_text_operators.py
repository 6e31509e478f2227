"""Word blocks, byte-pair encoding, the positional index and the Jaccard join against plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gradeloom.llm import blocks, bpe, jaccard, postings
from gradeloom.llm.components import connected_components

PATH = public_tokenizers.path("byte_bpe_50k.json")
NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return [w for w in NOT_WORD.split((text or "").translate(LOWER)) if w]


def blank(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ9 .\n\té€😀_`{\x1c", max_size=30)), max_size=6))
def test_words(texts):
    column = pa.array(texts, pa.string())
    for wanted, plain in ((blocks.ALPHANUMERIC, alnum), (blocks.NOT_BLANK, blank)):
        words = blocks.Splitter(wanted)(column)
        expected = [plain(t) for t in texts]
        assert np.diff(words.first).tolist() == [len(e) for e in expected]
        flat = [w for e in expected for w in e]
        data = blocks.text_bytes(column)[0].tobytes()
        assert [data[a:b].decode().translate(LOWER) for a, b in zip(words.start, words.end)] == flat
        assert len(set(zip(flat, words.hash.tolist()))) == len(set(flat)) == len(set(words.hash.tolist()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.integers(1, 5))
def test_shingles(docs, width):
    words = blocks.Splitter(blocks.NOT_BLANK)(pa.array([" ".join(d) for d in docs], pa.string()))
    found = list(blocks.shingles(words, width))
    for d, f in zip(docs, found):
        plain = {tuple(d[k : k + width]) for k in range(max(1, len(d) - width + 1))} if d else set()
        assert len(f) == len(plain) and (np.diff(f.astype(object)) > 0).all()


def test_slices_never_cut_a_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "b", "c" * 5, ""])], names=["t"])
    parts = [p.column("t").to_pylist() for p in blocks.slices([batch], "t", 8)]
    assert [t for p in parts for t in p] == batch.column("t").to_pylist() and len(parts) == 2


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.TextCodec(f.read()), Tokenizer.from_file(PATH)


def encoded(codec, texts):
    ids, upto = codec.encode(*blocks.text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]


def test_encoding_equals_the_library(codec):
    own, library = codec
    rnd = random.Random(3)
    texts = ["", " ", "a<|endoftext|>b", "<|endof", "text|>", "it's we'll DON'T 'salt' x!'s \n'd", "aaaaaaaaaaaaaaaa", " " * 40 + "x",
             "\n\n  \t x", "\x1c\x85\xa0　b"]
    texts += ["".join(rnd.choice("aehtinosrvlmd '''\n\t 09.!é€😀漢字ñ") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice((rnd.randrange(32, 0xD7FF), rnd.randrange(0x10000, 0x1F000)))) for _ in range(9)) for _ in range(800)]
    for t, ids, expected in zip(texts, encoded(own, texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == expected.ids
        assert own.decode(ids).decode() == t == library.decode(expected.ids, skip_special_tokens=False)


def test_trie_equals_replayed_merges(codec):
    vocabulary = codec[0].vocabulary
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b" aeinrst.\xc3\xa9") for _ in range(rnd.randrange(1, 12))) for _ in range(1500)]
    assert codec[0].encoder.encode(words) == [bpe.merged(vocabulary, w) for w in words]


def test_encode_texts_of_odd_tables(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (None, None, None), (3, "", 0), (4, "é" * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = {(r.doc_id, r.decoded): r for r in bpe.encode_texts(docs, PATH).collect()}
    assert bpe.encode_texts(docs, PATH).count() == 5
    assert out[1, "Hello there"].n_tokens == 2 and out[None, ""].n_tokens == out[3, ""].n_tokens == 0
    assert out[3, ""].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[4, "é" * 200_000].decoded_sha256 == hashlib.sha256(("é" * 200_000).encode()).hexdigest()
    assert bpe.encode_texts(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.ByteVocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def plain_hits(docs, items, window):
    out = []
    for key, text in docs:
        words, hit, found = alnum(text), set(), set()
        for item, item_text in items:
            own = alnum(item_text)
            if item is None or not own:
                continue
            size = min(window, len(own))
            for k in range(max(1, len(own) - window + 1)):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == own[k : k + size]:
                        hit.update(range(p, p + size))
                        found.add(str(item))
        out.append((key, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [1, 1_000_000])
def test_contamination(spark, monkeypatch, group):
    monkeypatch.setattr(postings, "QUERY_WORDS", group)
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(["a", "B", "c9", "é", "dd"]) for _ in range(n))
    items = [(10, prose(4)), (9, prose(2)), (9, prose(7)), (None, "a"), (12, None), (13, "..."), (14, "never seen words")]
    docs = [(k % 7 or None, prose(rnd.randrange(30))) for k in range(40)] + [(1, None), (1, ""), (2, "A b"), (2, "A b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "2 AS segment")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = postings.contamination(d.repartition(3), b, window=3).collect()
    assert sorted(((r.doc_key, r.n_words, r.n_hit, r["items"]) for r in out), key=repr) == plain_hits(docs, items, 3)
    assert all(r.contaminated == (r.n_hit > 0) and sum(s.b - s.a for s in r.spans) == r.n_hit for r in out)
    none = postings.contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert postings.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one x two three"), (2, "three one two"), (3, "one two three"), (4, "one x x x two three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for slack, expected in ((0, {3}), (1, {1, 3}), (2, {1, 2, 3, 4})):
        found = postings.contamination(d, b, slack=slack).where("contaminated").collect()
        assert {r.doc_key for r in found} == expected


def plain_groups(n, linked):
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if linked(a, b) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


@pytest.mark.parametrize("width,percent,nodes", [(4, 85, 2_048), (5, 80, 3), (1, 50, 2)])
def test_jaccard_groups(spark, monkeypatch, width, percent, nodes):
    monkeypatch.setattr(jaccard, "TILE_NODES", nodes)
    monkeypatch.setattr(jaccard, "MANY_GROUPS", 2)  # the rounds between groups take part
    rnd = random.Random(width)
    texts = [None, "", "  \n", "one", "One", "one two", "one two three four", "same words here again"]
    for _ in range(8):
        base = [rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(rnd.randrange(8, 90))]
        for _ in range(rnd.randrange(1, 9)):
            copy = [w if rnd.random() > 0.03 else "new" + str(rnd.randrange(99)) for w in base]
            texts.append(" ".join(copy + ["the shared line of all texts"] * (rnd.random() < 0.5)))
    texts += texts[-6:]
    rnd.shuffle(texts)

    def shingled(t):
        w = blank(t)
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingled(t) for t in texts]
    linked = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs = docs.selectExpr("doc_id", "text", "'x' AS node", "1 AS n", "2 AS key")
    out = sorted((r.doc_key, r.n_shingles, r.group_key) for r in jaccard.jaccard_groups(docs, width=width, percent=percent).collect())
    assert out == [(k, len(sets[k]), g) for k, g in enumerate(plain_groups(len(texts), linked))]


def test_jaccard_odd_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, None), (7, None)], "doc_id long, text string")
    out = [(r.doc_key, r.n_shingles, r.group_key) for r in jaccard.jaccard_groups(docs).collect()]
    assert sorted(out, key=repr) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (7, 0, 7)], key=repr)
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def test_bitmap_bounds_the_overlap():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 400, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        bits = jaccard.folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        differing = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differing <= len(np.setxor1d(a, b))


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200 + k) for k in range(1, 40)]
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
    near = set(links)
    names = sorted({x for e in links for x in e if e[0] != e[1]})
    place = {x: k for k, x in enumerate(names)}
    plain = plain_groups(len(names), lambda a, b: (names[a], names[b]) in near)
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: names[plain[place[x]]] for x in names}
    assert connected_components(df.limit(0)).count() == 0


def test_pairs_of_nearest_groups():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.random(120) < 0.93], rnd.integers(0, 2**63, int(rnd.integers(0, 12)), dtype=np.uint64)])) for _ in range(40)]
    nodes, sizes = np.arange(40) * 7, np.array([len(s) for s in sets])
    bits, groups = jaccard.folded([jaccard.bitmap(s) for s in sets]), np.arange(40) // 3
    for turn in (1, 2):
        pairs = jaccard.group_pairs(nodes, sizes, bits, 80, groups, turn)
        ends = [(a // 7, b // 7) for a, b in pairs]
        assert pairs and all(groups[a] != groups[b] for a, b in ends) and len({a for a, _ in ends}) <= 14
        assert all(b in jaccard.within_bound(sizes, bits, a, np.arange(40), 80) for a, b in ends)
        for a in {a for a, _ in ends}:
            own = [groups[b] for x, b in ends if x == a]
            assert len(own) == len(set(own)) <= jaccard.BEST_GROUPS

"""Vector codes, collocations and line dedup against plain Python, and their odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from gradeloom.llm import codebooks, collocations, lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts, entries, rounds):
    """(key, label, codes, error) of usable rows by full scans in Python integers, and the codebooks."""
    rows = sorted(((k, v, la) for k, la, v in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    ints = [[int(np.floor(4096 * x)) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    book = [[v[p * width : (p + 1) * width] for v in ints[:entries]] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e)), k) for k, e in enumerate(book[p])) for p in range(parts)]
            for v in ints
        ]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                own = [v[p * width : (p + 1) * width] for v, n in zip(ints, near) if n[p][1] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    out = [(k, la, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for (k, _, la), n in zip(rows, near)]
    return out, book


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from((3, 1 << 12, 1 << 27)))
def test_reassigned_equals_a_full_scan(seed, top):
    rnd = np.random.default_rng(seed)
    values = rnd.integers(-top, top, (30, 4))
    entries = rnd.integers(-top, top, (5, 4))
    codes, dists = codebooks.nearest(values, entries)
    moved = rnd.random(5) < 0.5
    entries[moved] += rnd.integers(-top // 2, top // 2 + 1, (int(moved.sum()), 4))
    expected = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(entries)) for v in values]
    got = codebooks.reassigned(values, entries, moved, codes, dists)
    assert list(zip(got[1].tolist(), got[0].tolist())) == expected


def test_codes_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "CHUNK_ROWS", 16)
    rnd = random.Random(1)
    rows = [(k, rnd.choice((None, 1, 2)), [rnd.choice((-0.5, 0.25, 0.0, rnd.uniform(-1, 1))) for _ in range(8)]) for k in range(150)]
    rows += [(200 + k, 3, rows[7][2]) for k in range(60)] + [rows[5], rows[5], (None, None, rows[0][2])]  # copies, repeated rows, a null key
    odd = [(-1, 1, None), (-2, 1, [float("nan")] * 8), (-3, 2, [float("inf")] + [0.0] * 7), (-4, 2, [None] + [0.0] * 7)]
    unfit = [(900, 7, [1.0] * 6), (901, 7, []), (902, None, [1e30] * 8)]
    schema = "vec_id long, label int, embedding array<double>, key string, code int, sums int, values int, l int"
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows + odd + unfit], schema).repartition(5)
    coded = codebooks.vector_codes(table, parts=4, entries=6, rounds=4)
    expected, book = plain_codes(rows, 4, 6, 4)
    assert coded.codebooks.tolist() == book
    sums = defaultdict(int)
    for _, label, _, error in expected:
        sums[label] += error
    expected = [(*e, sums[e[1]]) for e in expected]
    expected += [(900, 7, None, None, None), (901, 7, None, None, None), (902, None, None, None, sums[None])]
    got = [tuple(r) for r in codebooks.with_label_error(coded.rows).select("vec_key", "label", "code", "error", "label_error").collect()]
    assert Counter(got) == Counter(expected)


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    coded = codebooks.vector_codes(spark.createDataFrame([], schema))
    assert coded.rows.count() == 0 and coded.codebooks.size == 0
    coded = codebooks.vector_codes(spark.createDataFrame([(2, None, [1.0] * 8), (1, 4, [1.0] * 8)], schema))
    assert [tuple(r) for r in coded.rows.orderBy("vec_key").collect()] == [(1, 4, "00" * 8, 0), (2, None, "00" * 8, 0)]
    coded = codebooks.vector_codes(spark.createDataFrame([(2, 1, [1.0] * 7)], schema))
    assert [tuple(r) for r in coded.rows.collect()] == [(2, 1, None, None)]
    with pytest.raises(ValueError):
        codebooks.vector_codes(coded.rows, entries=300)


# ---------------------------------------------------------------- collocations


def plain_collocations(docs, max_words=3, least=10, percent=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: a for g, a in counts.items() if len(g) >= 2 and a >= least}
        rows = []
        for g, a in candidates.items():
            score, _, left, right = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            longer = [b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if all(100 * b < percent * a for b in longer):
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def random_docs(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "é", "x'y", " ", "new", "york", "city", "-"]
    return [
        (rnd.choice((None, "en", "de")), "".join(rnd.choice(words) + rnd.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ",", "new york city ")) for _ in range(rnd.randrange(60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("max_words, least, top", [(3, 10, 2000), (4, 3, 2000), (2, 5, 7), (5, 4, None)])
def test_collocations_equal_plain_python(spark, monkeypatch, max_words, least, top):
    monkeypatch.setattr(collocations, "RUN_BYTES", 500)
    monkeypatch.setattr(collocations, "PART_PHRASES", 50)
    docs = random_docs(max_words) + [("en", None), (None, ""), ("en", " .,;"), ("xx", "alone")]
    docs += [("en", "new york " * 3000), ("en", "w" * 20000 + " tail. ")] + [("fr", "long" * 50 + " word")] * 12
    schema = "lang string, text string, run long, phrases string, a int, counts int"
    table = spark.createDataFrame([(*d, 1, "p", 2, 3) for d in docs], schema).repartition(4)
    got = collocations.collocations(table, max_words=max_words, min_count=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, max_words, least, 50, top)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, max_words=1)


def test_scores_beyond_64_bits(spark):
    """a * a * 1,000,000 is 3.6e19 here, above 2**63."""
    docs = [("en", "p q " * 60000)] * 100
    rows = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), max_words=2)
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in rows.collect()}
    a, b = 6_000_000, 6_000_000 - 100
    assert got == {"p q": (a, a, a, 10**6), "q p": (b, a, a, 10**6 * b * b // (a * a))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\n\t,!", max_size=20)), max_size=5))
def test_places(texts):
    words, places = collocations.word_places(pa.array(texts, pa.string()))
    pieces = [re.findall(r"[^ \t]+", p.translate(LOWER)) for t in texts for p in re.split(r"[.,;:!?\n-\r]", t or "")]
    assert [w for w in words.to_pylist()] == [w for p in pieces for w in p]
    runs = np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) != 1) + 1) if len(places) else []
    assert [len(r) for r in runs] == [len(p) for p in pieces if p]


# ---------------------------------------------------------------- line dedup


def plain_lines(docs, least, chars):
    keyed = [[li.strip(" \t\n\x0b\x0c\r").translate(LOWER) for li in (t or "").split("\n")] for _, t in docs]
    counts = Counter(k for keys in keyed for k in set(keys))
    out = []
    for (doc, text), keys in zip(docs, keyed):
        stay = [li for li, k in zip((text or "").split("\n"), keys) if len(k) < chars or counts[k] < least]
        out.append((doc, len(keys), len(keys) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 1), (3, 4), (1, 0)])
def test_lines_equal_plain_python(spark, least, chars):
    rnd = random.Random(least)
    stock = ["Home | About", " home | ABOUT\t", "é", "É", "", "  ", "\x0b\x0c", " ", "abc", "a\rb", "€uro"] + [f"line {k}" for k in range(40)]
    docs = [(k, "\n".join(rnd.choice(stock) for _ in range(rnd.randrange(9)))) for k in range(80)]
    docs += [(200, None), (201, ""), (None, "line 1\nabc"), (None, "line 2"), (5, "other\nabc"), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(300, "\n".join(f"row {k}" for k in range(20000)) + "\nabc"), (301, "x" * 300000 + "\nline 3")]
    schema = "doc_id long, text string, key int, x string, line string, gone string, kx int"
    table = spark.createDataFrame([(*d, 1, "x", "y", "z", 2) for d in docs], schema).repartition(4)
    got = lines.without_common_lines(table, min_docs=least, min_chars=chars)
    assert got.columns == ["doc_key", "n_lines", "n_dropped", "text"]
    assert Counter(tuple(r) for r in got.collect()) == plain_lines(docs, least, chars)


def test_lines_of_nothing(spark):
    assert lines.without_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_hashes():
    hashes = lines.line_hashes("A\n a \nÉ\né\n\n".encode(), 1)
    assert hashes[0] == hashes[1] and hashes[2] != hashes[3] and hashes[4:] == [None, None]
    assert hashes[0] == hashlib.blake2b(b"a", digest_size=16).digest()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**62))))
def test_packed(values):
    values = np.array(values, np.int64)
    assert collocations.unpacked(collocations.packed(values)).tolist() == values.tolist()


def test_numbers_of_large_ids():
    heads, lasts = np.array([5, 1, 5, 5]) + (1 << 40), np.array([1, 2, 1, 0])
    first, which = collocations._numbered(heads, lasts)
    assert [(heads[f] - (1 << 40), lasts[f]) for f in first] == [(1, 2), (5, 0), (5, 1)] and which.tolist() == [2, 0, 2, 1]

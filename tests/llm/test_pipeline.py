"""The pipeline's stages on whole tables, against plain Python where there is no training, and on odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import familiar
from gradeloom.sources.shared import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = [(None, None, None, None, None), (None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "!!! 123", None, "s", 7)]
    return materialize(docs.unionByName(spark.createDataFrame(odd, docs.schema)).select(columns), "docs")


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(lower)) if w]


def test_near_duplicates_leave_one_of_each_group(spark, docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    rows = list(dict.fromkeys(tuple(r) for r in docs.collect()))
    sets = []
    for r in rows:
        w = words(r[docs.columns.index("text")])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    smallest = {}
    for r, g in zip(rows, group):
        smallest[g] = min(smallest.get(g, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(kept, key=repr) == sorted(smallest.values(), key=repr)


def test_filters_take_effect(spark, docs):
    good = corpus_pipeline.keep_good(spark, docs, SF)
    told = corpus_pipeline.keep_language(spark, docs, SF)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert good.columns == told.columns == clean.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) / len(labels) > 0.97
    told = [r.doc_id for r in told.collect()]
    assert -2 not in told and -1 not in told and len(told) > 0.95 * docs.count()
    assert 0 < clean.count() < docs.count()
    assert corpus_pipeline.drop_contaminated(spark, clean, SF).count() == clean.count()


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "tokens"]
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert 0 < len(rows) == len(ids) < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in rows)


def test_empty_documents(spark, docs):
    empty = docs.where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize("learned", [["en"], ["en", "fr"], ["de", "en", "es", "fr"]])
def test_language_stage_rejects_junk_and_foreign_texts(spark, learned):
    """Planted beside clean documents: shuffled letters, key mash, and texts of languages without labelled rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 200 AND 3000")
    random = np.random.default_rng(5)
    texts = {x: [r.text for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(60).collect()] for x in ("de", "en", "es", "fr")}
    rows = [(f"clean {k}", t, x, "s", 0) for x in learned for k, t in enumerate(texts[x][:45])]
    # Not labelled: rows of learned languages, and texts of others, which must not be taught as a language.
    rows += [(f"clean unlabelled {x} {k}", t, None, "s", 0) for x in learned for k, t in enumerate(texts[x][45:])]
    rows += [(f"foreign {x} {k}", t, None, "s", 0) for x in texts if x not in learned for k, t in enumerate(texts[x][:15])]
    rows += [(f"junk {x} {k}", familiar.shuffled(t.encode(), random).decode(), None, "s", 0) for x in learned for k, t in enumerate(texts[x][:15])]
    mash = [" ".join("".join(random.choice(list("qwertzuiopasdfghjklyxcvbnm"), 6)) for _ in range(30)) for _ in range(20)]
    mash += ["Съешь же ещё этих мягких французских булок да выпей чаю", "xkcd vfgt zzzqqq wrtpsd hjklmn bvcxzq ppllkk"]
    rows += [(f"junk mash {k}", t, None, "s", 0) for k, t in enumerate(mash)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.keep_language(spark, frame, SF).collect()}
    bad = {r[0] for r in rows if not r[0].startswith("clean")}
    good = {r[0] for r in rows if r[0].startswith("clean")}
    assert len(kept & bad) <= 0.03 * len(bad), sorted(kept & bad)
    assert len(kept & good) >= 0.97 * len(good), sorted(good - kept)


def test_language_stage_without_labels_drops_texts_without_letters(spark):
    rows = [(1, None), (2, ""), (3, "!!! 123"), (4, "some words"), (5, "слово")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "cast(null AS string) AS lang")
    assert {r.doc_id for r in corpus_pipeline.keep_language(spark, docs, SF).collect()} == {4, 5}


@pytest.mark.parametrize("few", [3, 9, 30])
def test_language_stage_keeps_rare_languages(spark, few):
    """A few labelled French texts beside many others stay, and so do the others; junk beside them goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 200 AND 3000")
    random = np.random.default_rng(3)
    others = [r for r in docs.where("lang <> 'fr'").orderBy("doc_id").limit(500).collect()]
    french = [r.text for r in docs.where("lang = 'fr'").orderBy("doc_id").limit(few).collect()]
    rows = [(f"fr {k}", t, "fr") for k, t in enumerate(french)] + [(f"other {r.doc_id}", r.text, r.lang) for r in others]
    rows += [(f"junk {r.doc_id}", familiar.shuffled(r.text.encode(), random).decode(), None) for r in others[:40]]
    frame = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.keep_language(spark, frame, SF).collect()}
    assert {f"fr {k}" for k in range(few)} <= kept
    assert sum(k.startswith("other") for k in kept) >= 0.97 * len(others)
    assert sum(k.startswith("junk") for k in kept) <= 2


def test_samples_of_each_group(spark):
    from gradeloom.llm.samples import by_hash_of_each

    rows = [(f"k{k}", "a", 1) for k in range(3000)] + [(f"r{k}", "b", 1) for k in range(3)] + [("r1", "b", 1)]
    frame = spark.createDataFrame(rows, "t string, g string, of_group_2 int").selectExpr("*", "xxhash64(t) AS h")
    got = by_hash_of_each(frame, "h", "g", 40).collect()
    smallest = sorted(r.h for r in frame.where("g = 'a'").collect())[:20]
    assert sorted(r.h for r in got if r.g == "a") == smallest and sorted(r.t for r in got if r.g == "b") == ["r0", "r1", "r2"]
    assert by_hash_of_each(frame.where("false"), "h", "g", 40).count() == 0


def test_extra_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "doc_id AS row_key", "'x' AS row_x", "2 AS row_y", "3 AS key", "4 AS node", "5 AS _row_x")
    extra = materialize(extra, "docs")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        kept = stage(spark, extra, SF)
        assert kept.columns == extra.columns
        rows = kept.collect()
        assert rows and all(r.row_key == r.doc_id and r.row_x == "x" and r.row_y == 2 for r in rows)

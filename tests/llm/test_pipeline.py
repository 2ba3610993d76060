"""Each stage of the pipeline against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from parafid.llm import decontam, markov, simhash
from parafid.llm.common import Store


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out, store = spark.read.parquet(f"{sf}/documents.parquet"), [], Store(spark, "t")
    out.append(docs)
    for _, f in cp.STAGES:
        docs = store.keep(f(spark, docs, sf))
        out.append(docs)
    return [d.cache() for d in out]


def test_columns_and_ids(stages):
    for d in stages[:-1]:
        assert d.columns == stages[0].columns
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in stages]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 500


def test_language_keeps_clean_documents(stages):
    gone = stages[0].join(stages[1], "doc_id", "left_anti")
    assert gone.filter(F.col("n_chars") > 200).count() <= 0.01 * stages[0].count()


def plain_near_copies(texts, width=5, least=0.8):
    """Smallest key of each key's component, from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(len(w) - width, 0) + 1)}
    ids, label = sorted(sets), {i: i for i in sets}
    near = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    change = True
    while change:
        change = False
        for i, j in near:
            low = min(label[i], label[j])
            change |= label[i] != label[j]
            label[i] = label[j] = low
    return label


def test_one_of_each_group_stays(stages):
    want = plain_near_copies({r.doc_id: r.text for r in stages[1].collect()})
    assert {r.doc_id for r in stages[2].collect()} == set(want.values()) and len(set(want.values())) < len(want)


def test_near_copies_by_jaccard(stages, spark):
    """Copies with changed words are found where their five-word shingles say so, whatever their fingerprints."""
    import random
    rng = random.Random(7)
    texts = {r.doc_id: r.text for r in stages[1].limit(200).collect()}
    for i, t in [(k, t) for k, t in sorted(texts.items()) if 30 <= len(t.split()) <= 600][:60]:
        w = t.split()
        for c in range(1, 4):
            v = list(w)
            for _ in range(max(1, int(len(w) * rng.choice([.01, .02, .03])))):
                v[rng.randrange(len(v))] = f"new{rng.randrange(99)}"
            texts[i + c * 10**7] = " ".join(v)
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_near_copies(texts)
    assert 20 < len(texts) - len(set(want.values()))
    got = {r.doc_id for r in cp.near_dedup(spark, d, "/root/testdata/sf0.001").collect()}
    assert got == set(want.values())
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert any(want[i] != i and (prints[i] ^ prints[want[i]]).bit_count() > 2 for i in texts)


def test_parities_bound_the_difference():
    import numpy as np
    from parafid.llm import overlap
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (3, 900), (300, 310), (5000, 4500), (40, 40)):
        x, y = (np.unique(rng.integers(0, 1 << 13, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        low = overlap.least_difference(overlap.parity(x), overlap.parity(y))
        assert low <= len(np.setxor1d(x, y)) and overlap.least_difference(overlap.parity(x), overlap.parity(x)) == 0


def test_no_window_is_left(stages, spark):
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert decontam.decontaminate(stages[3], b).filter("contaminated").count() == 0
    bad = decontam.decontaminate(stages[2], b).filter("contaminated").count()
    assert stages[2].count() - stages[3].count() == bad > 0


def test_no_secret_is_left(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[3:5])
    assert set(before) == set(after)
    assert any(markov.base_spans(r.text) for r in before.values())
    for i, r in after.items():
        assert not markov.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[i].text or "[SECRET]" in r.text


def test_mix_takes_its_budgets(stages):
    rows = stages[5].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert rows and all(r.t == int(r.g) for r in rows)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "the cat sat on the mat", "en", "s", 1), (None, "the cat sat on the mat", "en", "s", 1), (1, None, "en", "s", 0),
            (2, "the cat sat on the mat", "en", "s", 1), (2, "the cat sat on the mat", "en", "s", 1), (3, "the cat sat on the mat", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    one = cp.language(spark, d, sf)
    assert one.count() == 5
    two = cp.near_dedup(spark, one, sf)
    assert [r.doc_id for r in two.collect()] == [2]
    assert cp.without_secrets(spark, cp.clean_of_benchmarks(spark, one, sf), sf).count() == 5
    for _, f in cp.STAGES:
        assert f(spark, d.limit(0), sf).count() == 0


WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def test_unlike_texts_under_one_id(spark):
    """Each row is a document: none is lost because another has its id, and copies without ids are found."""
    long = " ".join(WORDS * 9)
    rows = [(1, long), (1, "an unlike text of some words"), (None, long), (None, "a text without an id"), (None, "a text without an id"), (7, long + " more")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in cp.near_dedup(spark, d, "").collect())
    assert got == [("1", rows[1][1]), ("1", long), ("None", "a text without an id")]


CLASH = ("score lang_pred _text _whole _key _row _node key row component word hash node size prefix _size _prefix _bits id n_words n_hit "
         "contaminated clean_text spans kind").split()


@pytest.mark.parametrize("stage", range(4))
def test_columns_of_any_name_pass(spark, stage):
    """Columns named like those that operators make or use inside come out as they went in."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    more = d.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    f = cp.STAGES[stage][1]
    want, got = f(spark, d, sf).collect(), f(spark, more, sf)
    assert got.columns == more.columns
    got = got.collect()
    assert sorted(map(tuple, want)) == sorted(tuple(r)[:len(d.columns)] for r in got) and want
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASH)

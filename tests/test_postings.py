"""The stored index of the synonyms against lookups over the synonyms themselves."""

import random

import pytest
from pyspark.sql import functions as F

from parafid.operators import postings, terms
from parafid.sources import writers

SCHEMA = "cui string, term string, term_lower string, is_preferred boolean, semantic_types array<string>, ord int"


def synonyms(spark, names):
    return spark.createDataFrame([(f"C{i % 97}", n, n.lower(), i % 3 == 0, ["T1"], i) for i, n in enumerate(names)], SCHEMA)


def rows(df):
    return sorted((r.term, r["rank"], r.cui, r.syn_term, round(r.score, 8), r.is_preferred) for r in df.collect())


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Names of one to five words of unlike frequency; one word is in a third of them, a word may repeat in a name."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    names = {" ".join((["Disease"] if rnd.random() < .33 else []) + rnd.choices(words, [1 / (i + 1) for i in range(60)], k=rnd.randint(1, 5)))
             for _ in range(1500)}
    s = synonyms(spark, sorted(names) + ["!!!", "Éclair w1", "w1 w1"]).cache()
    return s, postings.write_index(s, str(tmp_path_factory.mktemp("index")), buckets=4), sorted(names)


@pytest.mark.parametrize(("limit", "min_score"), [(1, 0.0), (3, 5.0), (10_000, 0.0)])
def test_index_equals_the_lookup_over_all_synonyms(spark, mixed, limit, min_score):
    s, index, names = mixed
    asked = names[::40] + ["disease", "DISEASE w0", "w1 w1", "w1", "w0 w1 w2 w3", "unknown w7", "unknown", "!!!", " ", "", "eclair", "w2 w1 disease w0"]
    q = spark.createDataFrame([(t,) for t in [*asked, *asked[:5], None]], "term string")
    got = rows(terms.lookup_terms(q, index, limit, min_score))
    assert got == rows(terms.lookup_terms(q, s, limit, min_score)) and got


def test_what_builds_on_lookups_takes_the_index(spark, mixed):
    s, index, names = mixed
    q = spark.createDataFrame([(t,) for t in names[:30]], "term string")
    assert sorted(terms.top_concepts(q, index).collect()) == sorted(terms.top_concepts(q, s).collect())


def test_blocks_of_a_hot_token_are_skipped(spark, tmp_path):
    """A token in all of 40,000 names has 313 blocks at least; a term whose other token settles the match reads one of them or none."""
    name = F.concat(F.lit("t"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " disease").otherwise(" disease of the left side"))
    s = spark.range(40_000).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("cui"), name.alias("term"), name.alias("term_lower"), F.lit(False).alias("is_preferred"),
        F.expr("cast(array() as array<string>)").alias("semantic_types"), F.col("id").alias("ord"))
    index = postings.write_index(s, str(tmp_path), buckets=4)
    q = spark.createDataFrame([("chronic t44 disease",), ("disease",)], "term string")
    read = {r.term: r for r in index.blocks_read(q, 1).collect()}
    assert read["chronic t44 disease"].blocks_held > 313 and read["chronic t44 disease"].blocks_read <= 4
    # a lone token: the level of the short names holds the best, the long names' level is left alone
    assert read["disease"].blocks_read < 0.6 * read["disease"].blocks_held
    top = terms.lookup_terms(q, index, 1).collect()
    assert {r.term: r.cui for r in top} == {"chronic t44 disease": "C44", "disease": "C0"}
    # no block holds many more rows than its share
    blocks = spark.read.parquet(f"{tmp_path}/postings")
    assert blocks.agg(F.max(F.size("rows"))).first()[0] < 2 * postings.ROWS


def test_empty_and_unusable_synonyms(spark, tmp_path):
    q = spark.createDataFrame([("heart",)], "term string")
    empty = postings.write_index(synonyms(spark, ["x"]).limit(0), str(tmp_path / "e"), 2)
    assert terms.lookup_terms(q, empty).count() == 0
    bad = spark.createDataFrame([("C1", "Heart", "heart", True, None, 1), (None, "Heart", "heart", True, [], 2), ("C2", None, None, True, [], 3)], SCHEMA)
    assert [r.cui for r in terms.lookup_terms(q, postings.write_index(bad, str(tmp_path / "b"), 2)).collect()] == ["C1"]


def test_writer_counts_failures_and_stores_the_index(spark, tmp_path):
    c = spark.createDataFrame([("C1",), (None,)], "cui string")
    s = spark.createDataFrame([("C1", "Heart", "heart", True, [], 1), ("C1", None, None, False, [], 2), (None, "x", "x", False, [], 3)], SCHEMA)
    got = {r.table: (r.rows, r.failed) for r in writers.write_terminology(c, s, str(tmp_path), buckets=2, index=True).collect()}
    assert got == {"concepts": (1, 1), "synonyms": (1, 2)}
    index = postings.TermIndex(spark, f"{tmp_path}/index")
    assert index.finished() and index.stats["rows"] == 1
    q = spark.createDataFrame([("HEART",)], "term string")
    assert [r.cui for r in terms.lookup_terms(q, index).collect()] == ["C1"]
    # without force a finished index stays
    assert postings.write_index(s.limit(0), f"{tmp_path}/index", force=False).stats["rows"] == 1

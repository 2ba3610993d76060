"""Findings of round 4."""

from pyspark.sql import functions as F

from parafid.operators import validate
from parafid.plans import catalog


def _rows(spark, folder, orders):
    """Tables of one folder: ``orders`` rows (o_orderkey, o_custkey) and one line of text for each."""
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    lines = [(k, 1, 38, 2, 5.0) for k, _ in orders]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(
        f"{folder}/lineitem.parquet")
    return str(folder)


# the entailment step of the recommendation gate
def test_recommendations_are_scored_against_their_premise(spark, tmp_path):
    d = _rows(spark, tmp_path, [(1, 9)])
    got = {(r.pair_id, r.summary_span): r.message for r in catalog.QUERIES["validate_recommendations"](spark, d).collect()}
    text = "Action sentence contradicts original (NLI: contradiction, conf: {}%)"
    assert got == {
        (1, "You need surgery."): text.format("100.00"), (1000000001, "You should take your medicine dose daily."): text.format("100.00"),
        (1000000001, "This is a stroke and you need surgery."): text.format("97.44")}  # no shared word, so the whole text: "a", of 39


def test_entailed_advice_is_no_error(spark):
    from parafid.plans.q_validate import similarity_score
    rows = [(1, "The scan is clear. You should take aspirin every day.", "You should take aspirin every day. You need surgery.")]
    df = spark.createDataFrame(rows, "pair_id int, original string, simplified string")
    e = df.select(F.explode(validate.recommendations(F.col("original"), F.col("simplified"), similarity_score)).alias("e"))
    assert [r.summary_span for r in e.select("e.summary_span").collect()] == ["You need surgery."]


# F3, F8: numbers, their noise and readings of ASCII texts go a shorter way
def _noisy_texts():
    import random
    rnd = random.Random(4)
    tokens = ("1 12 1994 107 64 1234567 3.5 / - : . , # ( \n of page MRN jan March may a left mg MM mmHg % am in \" 11/20/1994 6/18/2019 "
              "120/80 12/15 555-123-4567 10:30 word pressure was _").split(" ")
    return [rnd.choice(["", " "]).join(rnd.choice(tokens) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]


def test_ascii_texts_give_what_other_texts_give(spark):
    """Behind a full stop and more than a context's width, a letter that is not ASCII sends the text the longer way."""
    from parafid.functions import extract
    d = spark.createDataFrame([(t + "." + 60 * " ",) for t in _noisy_texts()], "t string").withColumn("u", F.concat("t", F.lit("é")))

    def found(c):
        cut = F.transform(extract.measurements(F.col(c)), lambda m: F.struct(m["value"], m["text"], m["unit"], F.rtrim(m["context"])))
        return F.struct(cut, extract.extract_critical(F.col(c)), extract.extract_measurement_keys(F.col(c)))
    assert d.filter(~found("t").eqNullSafe(found("u"))).limit(2).collect() == []
    assert d.filter(F.size(extract.extract_bp(F.col("t"))) > 0).count() > 20


def test_ascii_noise_test_equals_the_patterns(spark):
    from parafid.functions import rules, rx
    patterns = rules.DATE_PATTERNS + rules.IGNORE_PATTERNS
    d = spark.createDataFrame([(t[i:i + 60],) for t in _noisy_texts() for i in (0, 7, 31)], "t string")
    assert d.filter(F.col("t").rlike(rx.ascii_any_of(patterns)) != F.col("t").rlike(rx.any_of(patterns))).limit(2).collect() == []


# a filter on the prompt ran the gates again
def test_repair_prompt_runs_its_gates_once(spark, tmp_path):
    q = catalog.QUERIES["repair_prompt"](spark, _rows(spark, tmp_path, [(1, 9)]))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("META_TALK_DETECTED") == 1
    assert [r.pair_id for r in q.collect()] == [1]


# syllables are counted over all words at once
def test_syllables_in_a_row_equal_those_of_each_word(spark):
    from parafid.functions.readability import _counts
    from parafid.functions.text import syllables, words_apostrophe
    texts = ["", "the a I", "able table little rhythm employee don't couple's Eye queue apple circumstance evaluate ale idea", "simple", "e ee eee eeee whale's people"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for le in (True, False):
        each = F.transform(words_apostrophe(F.col("t")), lambda w: syllables(w, le))
        rows = d.select(_counts(words_apostrophe(F.col("t")), F.array(F.lit(1)), le).alias("n"), each.alias("each")).collect()
        assert [(r.n.w, r.n.syl, r.n.hard) for r in rows] == [(len(r.each), sum(r.each), sum(x >= 3 for x in r.each)) for r in rows]

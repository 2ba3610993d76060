"""Small cases of the third round's findings."""

from pyspark.sql import functions as F

from parafid.plans import fixtures


def test_narrow_fixtures_are_dealt(spark, sf_dir):
    """A file of one row group is not one task, whatever the settings of the session."""
    before = spark.conf.get("parafid.fixture.partitions", None)
    spark.conf.unset("parafid.fixture.partitions")
    try:
        want = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for made in (fixtures.reports(spark, sf_dir), fixtures.notes(spark, sf_dir)):
            assert made.select(F.spark_partition_id().alias("p")).distinct().count() == want > 1
    finally:
        if before is not None:
            spark.conf.set("parafid.fixture.partitions", before)


def test_short_quotes_make_no_pairs_of_texts(spark):
    """One and two words, cut at both ends, across repeats; ids of documents that repeat give rows of their own."""
    from parafid.plans.q_validate import edge_hits
    docs = {1: "the cat sat", 2: "bathe category", 3: "cat", 4: "", 5: "sat the", 6: "éthe cä the catalog the cats"}
    quotes = {1: "the cat", 2: "at", 3: "t", 4: "e c", 5: "the", 6: "catalog the", 7: "zz"}
    dw = spark.createDataFrame([(i, t.split()) for i, t in docs.items()], "doc_id long, dw array<string>")
    q = spark.createDataFrame(list(quotes.items()), "item_id long, quote string")
    found = edge_hits(dw, q)
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i, t in docs.items() for j, e in quotes.items() if e in t)


def test_look_aheads_change_no_match(spark):
    """Patterns start with a test of their first character, and find what they found without it."""
    from parafid.functions import rules, rx
    texts = ["Dose 17 mg, MAR 3, 2019; L4-L5 12/3/20 ſeptember 7 Kelvin 5 kg", "٣ mg x٣ 3%", "", "BP 120/80 mmHg #12 page 3 of 4"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for p, _ in rules.DATE_PATTERNS + rules.IGNORE_PATTERNS] + list(rules.CRITICAL_TYPED.values())
    assert any(rx.jrx(p, "i").startswith("(?Ui)(?=") for p in patterns)
    for p in patterns:
        plain = F.regexp_extract_all("t", F.lit(f"(?Ui){rx.expand(p)}"), F.lit(0))
        assert d.filter(~plain.eqNullSafe(rx.find_all(F.col("t"), p, "i"))).count() == 0


def test_sentence_words_are_cut_once(spark):
    """Given words choose the premise that the sentences do."""
    from parafid.operators import match
    d = spark.createDataFrame([("take aspirin daily", ["You need rest.", "Aspirin was taken daily.", "Take aspirin."])], "q string, s array<string>")
    given = match.best_premise(F.col("q"), F.col("s"), F.lit("x"), words=F.transform("s", match.premise_words))
    assert d.filter(given == match.best_premise(F.col("q"), F.col("s"), F.lit("x"))).count() == 1


ODD = ["Dose 5 mg and 3.5% on 12/3/2019", "\x01 7 mg \x02 8 cm", "BP 120/80 mmHg, 3 of 4", "page 3\n12 mg", "9 dec, 4 oct 5", "٣ mg x٣", "", None,
       "555-123-4567 or 12345678", "ſep 4 5 mg", "left.a l.x upper-left right", "R.2 right-sided l.", "éleft right", " 　a\t\x1f b ", "1-2-34 kg"]


def test_marked_matches_equal_split_ones(spark):
    """Offsets from marks are those from running lengths, for texts with marks of their own too."""
    from parafid.functions import extract as E
    from parafid.functions import rules, rx
    d = spark.createDataFrame([(t,) for t in ODD], "t string")
    for p, f in [*rules.DATE_PATTERNS, *rules.IGNORE_PATTERNS, (rules.BLOOD_PRESSURE, "i"), (E._unit_pattern("first"), "i")]:
        assert d.filter(~rx.spans(F.col("t"), p, f).eqNullSafe(rx.spans_of(F.col("t"), F.lit(rx.jrx(p, f))))).count() == 0, p
    rows = d.select("t", E.extract_numbers(F.col("t")).alias("n")).collect()
    assert all(r.n == [] for r in rows if not r.t)
    assert [(n.text, n.unit) for r in rows if r.t and "\x01" in r.t for n in r.n] == [("7", "m"), ("8", "cm")]


def test_texts_without_noise_keep_their_numbers(spark):
    """The test of the whole text changes no number; the context alone decides where it may."""
    from parafid.functions import extract as E
    d = spark.createDataFrame([(t,) for t in ODD], "t string")
    n = E.extract_numbers(F.col("t"))
    assert d.filter(~E.drop_ignored_numbers(n, F.col("t")).eqNullSafe(E.drop_ignored_numbers(n))).count() == 0


def test_literal_tests_see_the_dotted_capital_i(spark):
    """The pattern takes it for an i, so the literal that stands before the pattern has to."""
    from parafid.functions import extract as E
    d = spark.createDataFrame([("He was DİAGNOSED WITH x",)], "t string")
    assert len(d.select(E.extract_critical_typed(F.col("t"))["diagnosis"].alias("v")).first().v) == 1


def test_sides_without_cutting_words(spark):
    from parafid.functions import extract as E
    d = spark.createDataFrame([(t,) for t in ODD], "t string").filter("t is not null")
    for field, side in (("l", "left"), ("r", "right")):
        assert d.filter(E.sides(F.col("t"))[field] != (F.size(E.laterality(F.col("t"), side)) > 0)).count() == 0


def test_strip_and_collapse(spark):
    from parafid.functions import rx
    d = spark.createDataFrame([(t,) for t in [*ODD, " ", "a  b", "\x85a \n b "]], "t string")
    plain = F.regexp_replace("t", rf"^[{rx.WS}]+|[{rx.WS}]+\z", "")
    assert d.filter(~rx.strip(F.col("t")).eqNullSafe(plain)).count() == 0
    runs = F.regexp_replace(F.regexp_replace("t", f"[{rx.WS}]+", " "), "^ | $", "")
    assert d.filter(~rx.collapse(F.col("t")).eqNullSafe(runs)).count() == 0


def test_risk_terms_of_a_text(spark):
    from parafid.functions import extract as E
    texts = ["lung cancer and stroke", "no such thing", "MI and heart attack of terminal kind", "strokes", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert d.filter(~E.text_risk_terms(F.col("t")).eqNullSafe(E.risk_terms(E.extract_grounding_terms(F.col("t"))))).count() == 0


def test_noise_of_all_patterns_is_cut_by_one_expression(spark):
    """Spans of many patterns are those of each, marks in the text or not; the numeric gate stays small enough to build at once."""
    from unittest import mock

    from parafid.functions import rules, rx
    from parafid.operators import validate
    d = spark.createDataFrame([(t,) for t in ODD if t is not None], "t string")
    noise = rules.DATE_PATTERNS + rules.IGNORE_PATTERNS
    each = F.concat(*[rx.spans(F.col("t"), p, f) for p, f in noise])
    assert d.filter(~rx.spans_of_any(F.col("t"), rx.folded(F.col("t")), noise).eqNullSafe(each)).count() == 0
    with mock.patch.object(F, "aggregate", wraps=F.aggregate) as folds:
        validate.numeric(F.col("original"), F.col("simplified"))
    assert folds.call_count < 20


def test_rounds_share_built_gates(spark):
    """A later round does not build the gates again, and another order of texts is not taken for them."""
    from unittest import mock

    from parafid.operators import validate
    d = spark.createDataFrame([(1, "Dose 50 mg to the left side. Take aspirin daily.", "Dose 5 mg to the right side."), (2, None, "x")],
                              "pair_id long, original string, simplified string")
    first = validate.run_validators(d).select("pair_id", "results", "passed", "recall").orderBy("pair_id").collect()
    with mock.patch.object(F, "regexp_replace", side_effect=AssertionError("built again")):
        again = validate.run_validators(d, safety=False)
    assert [r.results for r in again.orderBy("pair_id").collect()] == [r.results for r in first]
    turned = d.select("pair_id", F.col("simplified").alias("original"), F.col("original").alias("simplified"))
    assert validate.run_validators(turned).orderBy("pair_id").first().results != first[0].results


def test_scored_sentences_are_matched_once(spark, sf_dir):
    """The query of contradictions cuts and compares sentences once, not once for the scores and once for the join."""
    from unittest import mock

    from parafid.operators import match
    from parafid.plans import catalog
    with mock.patch.object(match, "best_sentence_match", wraps=match.best_sentence_match) as made:
        assert catalog.QUERIES["validate_contradiction"](spark, sf_dir).count() > 0
    assert made.call_count == 1

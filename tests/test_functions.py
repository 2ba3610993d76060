"""Golden values derived by hand, and properties."""

import random
import re

from pyspark.sql import functions as F

from parafid.functions import extract as E
from parafid.functions import rules, rx, sets
from parafid.functions import text as T
from parafid.operators import report, sections, terms, validate
from parafid.sources.readers import parse_model_json


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("v")).first()["v"]


def test_numbers_take_the_first_unit_alternative(spark):
    got = one(spark, "5 mg, 120 mmHg and 3 lobes", E.extract_numbers(F.col("t")))
    assert [(r.value, r.unit) for r in got] == [(5.0, "m"), (120.0, "mm"), (3.0, "l")]
    longest = one(spark, "5 mg, 120 mmHg and 3 lobes", E.extract_numbers(F.col("t"), "longest"))
    assert [(r.value, r.unit) for r in longest] == [(5.0, "mg"), (120.0, "mmhg"), (3.0, None)]


def test_contexts_equal_a_position_scan(spark):
    rng = random.Random(7)
    pat = re.compile(rf"({rules.NUMBER})\s*({rules.UNITS_FIRST})?", re.IGNORECASE)
    for _ in range(5):
        text = "".join(rng.choice("ab 12.5mg%é\n") for _ in range(300))
        want = [(m.group(1), text[max(0, m.start() - 30):m.end() + 30]) for m in pat.finditer(text)]
        got = one(spark, text, E.extract_numbers(F.col("t")))
        assert [(r.text, r.context) for r in got] == want


def test_bp_inside_a_date_is_ignored(spark):
    got = one(spark, "On 10/12/2023 BP 120/80 mmHg.", E.extract_bp(F.col("t")))
    assert [r.value for r in got] == [120.0, 80.0]


def test_unicode_word_boundary(spark):
    assert one(spark, "Iechä ab", T.words_bounded(F.col("t"))) == ["ab"]


def test_exact_round_matches_python(spark):
    rng = random.Random(3)
    xs = [2.675, 9.825, 0.125, -2.5, 1.005] + [rng.randrange(100000) / 8 / 1000 for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 4):
        got = [r.v for r in df.select(sets.exact_round(F.col("x"), d).alias("v")).collect()]
        assert got == [round(x, d) for x in xs]


def test_action_first_rule_wins_and_repeats_drop(spark):
    got = one(spark, "Go to the hospital now. Go to the hospital now. Fatal.", E.action_sentences(F.col("t")))
    assert [(r.category, r.sentence) for r in got] == [
        ("emergency_directive", "Go to the hospital now."), ("prognosis_claim", "Fatal.")]


def test_identical_texts_lose_nothing(spark):
    t = "Diagnosed with acute stroke. Dose 5 mg to the left side. Blood pressure 120/80 mmHg."
    df = spark.createDataFrame([(1, t, t)], "pair_id int, original string, simplified string")
    codes = [r.code for r in validate.error_rows(validate.run_validators(df)).collect()]
    assert "NUMERIC_MISSING" not in codes and "LATERALITY_FLIP" not in codes and "CONCEPT_MISSING" not in codes
    row = df.select(validate.concept_safety(F.col("original"), F.col("simplified")).alias("z")).first().z
    assert row.recall == 1.0 and row.is_safe and not row.needs_review


def test_custom_and_extra_gates(spark):
    df = spark.createDataFrame([(1, "x" * 60, "y" * 60), (2, "x" * 60, "z" * 60)],
                               "pair_id int, original string, simplified string")
    shout = lambda o, s: F.when(s.contains("z"), F.array(validate.error("NUMERIC_ADDED", "LOW", "z"))).otherwise(
        F.expr(validate.NO_ERRORS)).cast(validate.ERRORS)
    extra = spark.createDataFrame([(1, "empty_chunk_validator", "EMPTY_CONTENT", "HIGH", "m", None, None, None)],
                                  "pair_id int, validator string, code string, severity string, message string, "
                                  "summary_span string, source_evidence string, fix string")
    out = validate.run_validators(df, ("empty_chunk_validator",), custom={"shout": shout}, soft=("shout",), extra_errors=extra)
    got = {r.pair_id: (r.passed, [(x.validator, x.passed) for x in r.results]) for r in out.collect()}
    assert got[1] == (False, [("empty_chunk_validator", False), ("shout", True)])
    assert got[2] == (True, [("empty_chunk_validator", True), ("shout", False)])


def test_repair_prompt_text(spark):
    df = spark.createDataFrame([(1, "Dose 5 mg now for the patient here today", "Nothing at all is said in this text about any dose or so")],
                               "pair_id int, original string, simplified string")
    p = validate.run_validators(df, safety=False).select(validate.repair_prompt(F.col("results")).alias("p")).first().p
    assert p.startswith('Mend the text as follows:') and "1. [NUMERIC_MISSING]" in p and "Suggested fix: " in p


def test_greedy_replacement_prefers_long_phrases(spark):
    got = one(spark, "a scan Within Normal limits and no sign of it", terms.fallback_canonicalize(F.col("t")))
    assert got == "a scan wnl and no it"


def test_json_ladder(spark):
    col = parse_model_json(F.col("t"), "struct<k:int>")
    for text, k in (('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('say [{"k": 3}] ok', 3), ("nothing", None)):
        v = one(spark, text, col)
        assert (v.k if v else None) == k


def test_sections(spark):
    assert one(spark, "nothing here", sections.detect_sections(F.col("t"))) is None
    got = one(spark, "intro\nPlan: rest\nmore\nLABS: ok", sections.section_chunks(F.col("t")))
    assert [(r.title, r.content) for r in got] == [(None, "intro"), ("PLAN", "rest\nmore"), ("LABS", "ok")]


def test_highlight_longest_term_first(spark):
    got = one(spark, "Left lung and lung", report.highlight_spans(F.col("t"), F.array(F.lit("lung"), F.lit("left lung"))))
    assert [(r.start, r.end, r.term) for r in got] == [(0, 9, "left lung"), (14, 18, "lung")]


def test_needles_cover_their_patterns():
    for p, _, _ in rules.ACTION_RULES:
        assert rx.needles(p)


def test_jaccard_symmetry(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["x"])], "a array<string>, b array<string>")
    r = df.select(sets.jaccard(F.col("a"), F.col("b")).alias("x"), sets.jaccard(F.col("b"), F.col("a")).alias("y")).collect()
    assert [(v.x, v.y) for v in r] == [(0.25, 0.25), (0.0, 0.0)]

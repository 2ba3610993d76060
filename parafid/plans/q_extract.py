"""Queries: pattern extraction over composed notes and clinical reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import rules
from ..functions.sets import exact_round
from . import sqlkit as K
from .fixtures import NOTES_SQL, REPORTS_SQL, notes, reports, spread, table
from .registry import query


def both_sides(df):
    """pair_id, side ('o' / 's'), t."""
    return df.select("pair_id", F.inline(F.array(
        F.struct(F.lit("o").alias("side"), F.col("original").alias("t")),
        F.struct(F.lit("s").alias("side"), F.col("simplified").alias("t")))))


TX = f"with {REPORTS_SQL}, {K.sides('reports')}"
NX = f"with {NOTES_SQL}, {K.sides('notes')}"


@query("extract_numbers", f"{TX}, {K.number_rows('nu', 'tx')} select pair_id, side, i-1 as pos, value, txt as text, unit, ctx as context from nu")
def extract_numbers(spark, d):
    n = both_sides(reports(spark, d)).select("pair_id", "side", F.posexplode(E.extract_numbers(F.col("t"))).alias("pos", "n"))
    return n.select("pair_id", "side", "pos", "n.value", "n.text", "n.unit", "n.context")


@query("extract_numbers_longest",
       f"{TX}, m as (select pair_id, side, unnest(regexp_extract_all(t, {K.q('(?i)' + '[0-9]+(?:[.][0-9]+)?')})) n from tx)"
       " select side, count(*) as numbers from m group by 1")
def extract_numbers_longest(spark, d):
    n = both_sides(reports(spark, d)).select("side", F.explode(E.extract_numbers(F.col("t"), "longest")).alias("n"))
    return n.groupBy("side").agg(F.count(F.lit(1)).alias("numbers"))


@query("extract_bp", f"{TX}, {K.bp_rows('bp', 'tx')} select pair_id, side, cast(txt as double) as value, unit, ctx as context from bp")
def extract_bp(spark, d):
    b = both_sides(reports(spark, d)).select("pair_id", "side", F.explode(E.extract_bp(F.col("t"))).alias("b"))
    return b.select("pair_id", "side", "b.value", "b.unit", "b.context")


@query("drop_ignored_numbers", f"{TX}, {K.number_rows('nu', 'tx')} select pair_id, side, value, txt as text, unit from nu where not {K.noisy('ctx')}")
def drop_ignored(spark, d):
    n = both_sides(reports(spark, d)).select("pair_id", "side", F.explode(
        E.drop_ignored_numbers(E.extract_numbers(F.col("t")), F.col("t"))).alias("n"))
    return n.select("pair_id", "side", "n.value", "n.text", "n.unit")


def lat_sql(side: str) -> str:
    words = rules.LATERALITY_LEFT if side == "left" else rules.LATERALITY_RIGHT
    return f"list_has_any({K.find_all('lower(t)', rules.LATERALITY_WORD)}, {K.words_list(words)})"


@query("extract_laterality", f"{NX} select pair_id, side, {lat_sql('left')} as has_left, {lat_sql('right')} as has_right from tx")
def laterality(spark, d):
    t = F.col("t")
    return both_sides(notes(spark, d)).select("pair_id", "side", (F.size(E.laterality(t, "left")) > 0).alias("has_left"),
                                              (F.size(E.laterality(t, "right")) > 0).alias("has_right"))


_UNITS = "case p_size%8 when 0 then 'CM3' when 1 then 'cm³' when 2 then ' inches ' when 3 then '\"' when 4 then 'feet' when 5 then 'ug' when 6 then 'mL' else '' end"
_UMAP = "MAP {" + ", ".join(f"{K.q(a)}: {K.q(b)}" for a, b in rules.UNIT_MAP.items()) + "}"


@query("normalize_unit", f"select p_partkey, nullif(coalesce({_UMAP}[u], u), '') as unit from (select p_partkey, {K.strip('lower(u)')} u from (select p_partkey, {_UNITS} u from part))")
def normalize_unit(spark, d):
    return table(spark, d, "part").select("p_partkey", E.normalize_unit(F.expr(_UNITS)).alias("unit"))


def _set_query(name, func, sql, fixture="reports", col="t"):
    src = TX if fixture == "reports" else NX

    @query(name, f"{src} select pair_id, side, len(a) as n, array_to_string(list_sort(a), '|') as items from (select pair_id, side, {sql} a from tx)")
    def run(spark, d):
        base = reports(spark, d) if fixture == "reports" else notes(spark, d)
        a = both_sides(base).select("pair_id", "side", func(F.col(col)).alias("a"))
        return a.select("pair_id", "side", F.size("a").alias("n"), F.array_join(F.array_sort("a"), "|").alias("items"))


LOWER = lambda m: f"lower({m})"
DRUGS_SQL = K.norm_set("t", rules.DRUG_PATTERNS, LOWER)
_set_query("extract_drug_names", E.extract_drug_names, DRUGS_SQL)
_set_query("extract_critical", E.extract_critical, K.norm_set("t", rules.CRITICAL_PATTERNS, K.strip))
for _g, _p in (("diagnosis", rules.DIAGNOSIS_PATTERNS), ("medication", rules.MEDICATION_PATTERNS),
               ("measurement", rules.MEASUREMENT_PATTERNS)):
    _set_query(f"extract_quality_{_g}", lambda c, g=_g: E.extract_quality_group(c, g), K.norm_set("t", _p, K.lower_collapse))
NOSPACE = lambda m: f"regexp_replace(lower({m}), {K.rx(chr(92) + 's+')}, '', 'g')"
KEYS_SQL = K.norm_set("lower(t)", rules.COVERAGE_MEASUREMENTS, NOSPACE)
_set_query("extract_measurements", E.extract_measurement_keys, KEYS_SQL)
_set_query("extract_plain_numbers", E.extract_plain_numbers, f"list_distinct({K.find_all('t', rules.PLAIN_NUMBER)})")
_set_query("extract_negations", E.extract_negations, f"list_distinct({K.find_all('lower(t)', rules.NEGATION, '', 1)})")
_set_query("glossary_candidates", E.glossary_candidates,
           f"list_distinct(list_concat({K.find_all('t', rules.GLOSSARY_WORD, 'i')}, {K.find_all('t', rules.GLOSSARY_DOSE, 'i', 1)}))")
_set_query("glossary_acronyms", lambda c: E.glossary_candidates(c, True),
           f"list_distinct(list_concat({K.find_all('t', rules.GLOSSARY_WORD)}, {K.find_all('t', rules.GLOSSARY_DOSE, 'i', 1)}))")

STOP = K.words_list(rules.STOP_WORDS + rules.CONTEXT_ALLOWLIST)
ALLOWED = (f"(list_contains({STOP}, p) or len(p)<{rules.MIN_TERM_LENGTH} or len(list_filter({K.words_ws('p')},"
           f" lambda w: not (list_contains({STOP}, w) or len(w)<3)))=0)")
GROUNDING_SQL = ("list_distinct(list_concat(list_filter(" + K.find_all("lower(t)", r"\b[a-zA-Z]{5,}\b") +
                 f", lambda w: not list_contains({STOP}, w)), list_filter(list_concat(" +
                 ", ".join(K.find_all("lower(t)", p, "", 1) for p in rules.GROUNDING_PHRASES) + f"), lambda p: not {ALLOWED})))")
RISK = "regexp_matches(x, " + K.q(r"\b(?:" + "|".join(rules.RISK_TERMS) + r")\b") + ")"
_set_query("extract_grounding_terms", E.extract_grounding_terms, GROUNDING_SQL)
_set_query("highest_risk_terms", E.text_risk_terms,
           f"list_filter({GROUNDING_SQL}, lambda x: {RISK})")


def typed_sql(t: str, pack=None) -> list[tuple[str, str]]:
    return [(n, K.norm_set(t, [p], K.lower_collapse)) for n, p in (pack or rules.CRITICAL_TYPED).items()]


def _typed(name, pack):
    @query(name, TX + " " + " union all ".join(
        f"select pair_id, side, {K.q(n)} as kind, unnest({s}) as item from tx" for n, s in typed_sql("t", pack)))
    def run(spark, d):
        m = both_sides(reports(spark, d)).select("pair_id", "side", F.explode(
            E.extract_critical_typed(F.col("t"), pack)).alias("kind", "items"))
        return m.select("pair_id", "side", "kind", F.explode("items").alias("item"))


_typed("extract_critical_typed", None)
_typed("extract_critical_typed_corrected", rules.CRITICAL_TYPED_CORRECTED)


@query("count_medical_terms", f"{TX} select pair_id, side, " + "+".join(
    f"len({K.find_all('lower(t)', p, 'i')})" for p in rules.MEDICAL_TERM_PATTERNS) + " as terms from tx")
def count_medical_terms(spark, d):
    return both_sides(reports(spark, d)).select("pair_id", "side", E.count_medical_terms(F.col("t")).alias("terms"))


# advice sentences: '.'-delimited segments, first rule of a segment wins, repeats dropped
def action_rows(src: str) -> str:
    case = "case " + " ".join(f"when regexp_matches(g, {K.rx(p, 'i')}) then {i + 1}" for i, (p, _, _) in enumerate(rules.ACTION_RULES)) + " end"
    cats = K.words_list([r[1] for r in rules.ACTION_RULES])
    sevs = K.words_list([r[2] for r in rules.ACTION_RULES])
    return f"""seg as (select pair_id, side, i-1 pos, a[i] g, len(a) n from (select pair_id, side, a, unnest(range(1, len(a)+1)) i
 from (select pair_id, side, string_split(t, '.') a from {src}))),
ruled as (select *, {case} rule, {K.strip("case when pos<n-1 then g||'.' else g end")} sentence, {K.strip('g')} phrase from seg),
acts as (select pair_id, side, rule, pos, {cats}[rule] category, {sevs}[rule] severity, sentence, phrase from ruled where rule is not null
 qualify row_number() over (partition by pair_id, side, sentence order by rule, pos)=1)"""


@query("detect_action_sentences", f"{TX}, {action_rows('tx')} select * from acts")
def detect_actions(spark, d):
    return both_sides(reports(spark, d)).select("pair_id", "side", F.inline(E.action_sentences(F.col("t"))))


EVIDENCE = "list_filter(list_concat(" + ", ".join(
    f"list_transform({K.find_all('{t}', p, f, 1)}, lambda m: {K.strip('m')})" for p, f in rules.EVIDENCE_PATTERNS) + "), lambda m: m<>'')"


@query("extract_evidence_spans", f"{TX} select pair_id, side, unnest({EVIDENCE.replace('{t}', 't')}) as item from tx")
def evidence_spans(spark, d):
    return both_sides(reports(spark, d)).select("pair_id", "side", F.explode(E.extract_evidence_spans(F.col("t"))).alias("item"))


CUE = "(" + " or ".join(f"regexp_matches(s, {K.rx(p, 'i')})" for p in rules.CLAIM_PATTERNS) + ")"


def claims_sql(t: str, spans: str) -> str:
    return (f"list_transform(list_filter(string_split_regex({t}, {K.rx('[.!?]' + chr(92) + 's+')}), lambda s: {CUE} and"
            f" len(list_filter({spans}, lambda e: contains(s, e) or contains(e, s)))=0), lambda s: {K.strip('s')})")


@query("find_ungrounded_claims", f"{TX} select pair_id, side, unnest({claims_sql('t', EVIDENCE.replace('{t}', 't'))}) as item from tx")
def ungrounded(spark, d):
    t = F.col("t")
    return both_sides(reports(spark, d)).select("pair_id", "side", F.explode(
        E.find_ungrounded_claims(t, E.extract_evidence_spans(t))).alias("item"))


KEYWORDS = ["Blood Pressure", "left lung.", "(aspirin)", "x", "knee?", "fever"]


@query("extract_keyword_entities", f"{TX}, k as (select unnest({K.words_list(['blood pressure', 'left lung', 'aspirin', 'knee', 'fever'])}) item)"
       " select pair_id, side, item from tx, k where regexp_matches(lower(t), '\\b'||item||'\\b')")
def keyword_entities(spark, d):
    kw = F.array(*[F.lit(k) for k in KEYWORDS])
    return both_sides(reports(spark, d)).select("pair_id", "side", F.explode(E.extract_keyword_entities(F.col("t"), kw)).alias("item"))


COMMON = K.words_list(rules.COMMON_LONG_WORDS)


def jargon_sql(w: str) -> str:
    return f"coalesce(len(list_filter({w}, lambda w: len(w)>8 and not list_contains({COMMON}, lower(w))))/nullif(len({w}), 0), 0.0)"


@query("jargon_density", f"select doc_id, round({jargon_sql('w')}, 4) as jargon from (select doc_id, {K.bounded_words('text')} w from documents)")
def jargon_density(spark, d):
    from ..functions.text import words_bounded
    w = spread(table(spark, d, "documents")).select("doc_id", words_bounded(F.col("text")).alias("w"))
    return w.select("doc_id", exact_round(E.jargon_density(F.col("w")), 4).alias("jargon"))


META = lambda x: "(" + " or ".join(f"regexp_matches({x}, {K.rx(p, 'i')})" for p in rules.META_TALK_PATTERNS) + ")"


@query("is_meta_talk", f"{TX} select pair_id, side, {META('t')} as meta from tx")
def meta_talk(spark, d):
    return both_sides(reports(spark, d)).select("pair_id", "side", E.is_meta_talk(F.col("t")).alias("meta"))


_LABEL = "case l_linenumber when 1 then 'Chemical' when 2 then 'DISORDER' when 3 then 'MyDrugName' when 4 then 'organ' when 5 then 'treatment' when 6 then 'ANATOMICAL' else 'gene' end"


@query("map_entity_label", f"""with e as (select l_orderkey, l_linenumber, upper({_LABEL}) u from lineitem)
select case when u in ('CHEMICAL','DRUG') or contains(u,'DRUG') or contains(u,'CHEM') then 'DRUG'
 when u in ('DISEASE','DISORDER','FINDING') or contains(u,'DISEASE') then 'DISEASE'
 when u in ('PROCEDURE','TREATMENT') or contains(u,'PROCEDURE') then 'PROCEDURE'
 when u in ('ANATOMY','BODY_PART','ORGAN') or contains(u,'ANAT') then 'ANATOMY' else u end as label, count(*) as entities from e group by 1""")
def entity_label(spark, d):
    e = table(spark, d, "lineitem").select(E.map_entity_label(F.expr(_LABEL)).alias("label"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("entities"))

"""Queries: rule gates, orchestration, repair loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import rules
from ..functions.rx import let, once
from ..functions.sets import exact_round, fuzzy_missing, word_jaccard
from ..operators import match, validate
from . import sqlkit as K
from .checkpoints import cut
from .fixtures import DIALOGUE_SQL, NOTES_SQL, REPORTS_SQL, dialogue, notes, reports, spread, table
from .loop import iterate_until_valid, legacy_fix_loop, validate_with_retry
from .q_extract import (EVIDENCE, GROUNDING_SQL, META, RISK, action_rows, claims_sql, lat_sql, typed_sql)
from .registry import query

def O():  # noqa: E743
    return F.col("original")


def S():
    return F.col("simplified")


def err_rows(df, errors, *fields):
    e = df.select("pair_id", F.inline(errors))
    return e.select("pair_id", *fields)


# ------------------------------------------------------------------------- V0
DENS = r"coalesce(len(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))/nullif(len({x}), 0), 0.0)".replace("{{", "{").replace("}}", "}")


def empty_sql(src: str) -> str:
    a, b = K.strip("original"), K.strip("simplified")
    dens = DENS.replace("{x}", "o")
    return f"""v0b as (select pair_id, {a} o, {b} s from {src}),
v0 as (select pair_id, 'EMPTY_CONTENT' code, 'MEDIUM' severity, 'Original text is too short ('||len(o)||' chars)' message from v0b where len(o)<20
 union all select pair_id, 'EMPTY_CONTENT', 'MEDIUM', 'Simplified text is too short ('||len(s)||' chars)' from v0b where len(s)<50
 union all select pair_id, 'META_TALK_DETECTED', 'HIGH', 'Simplified text contains AI meta-talk instead of actual content' from v0b where {META('s')}
 union all select pair_id, 'EMPTY_CONTENT', 'LOW', 'Original text has low content density ('||cast(round({dens}*100, 0) as int)||'%)' from v0b where {dens}<0.3 and len(o)>10)"""


_MIXED = "mixed as (select * from notes union all select pair_id+1000000000, original, simplified from reports)"


def mixed(spark, d):
    r = reports(spark, d)
    return notes(spark, d).unionByName(r.withColumn("pair_id", F.col("pair_id") + 1000000000))


@query("validate_empty_chunk", f"with {NOTES_SQL}, {REPORTS_SQL}, {_MIXED}, {empty_sql('mixed')} select * from v0")
def v_empty(spark, d):
    return err_rows(mixed(spark, d), validate.empty_chunk(O(), S()), "code", "severity", "message")


_THIN = "thin as (select pair_id, case when len(original)%4=1 then left(original, 15) else original end original, case len(original)%3 when 0 then left(simplified, 40) when 1 then '' else simplified end simplified from dialogue)"


@query("validate_empty_chunk_dialogue", f"with {DIALOGUE_SQL}, {_THIN}, {empty_sql('thin')} select * from v0")
def v_empty_dialogue(spark, d):
    """Dialogue pairs with short and lost texts among them."""
    k = F.length("original")
    thin = dialogue(spark, d).select("pair_id", F.when(k % 4 == 1, F.left("original", F.lit(15))).otherwise(O()).alias("original"),
                                     F.when(k % 3 == 0, F.left("simplified", F.lit(40))).when(k % 3 != 1, S()).alias("simplified"))
    return err_rows(thin, validate.empty_chunk(O(), S()), "code", "severity", "message")


# ------------------------------------------------------------------------- V1
def missing_sql(name: str = "v1a") -> str:
    """From ``ms``: distinct original values (2 digits) absent from the rewrite; first occurrence speaks."""
    return f"""{name} as (select pair_id, 'NUMERIC_MISSING' code, 'HIGH' severity,
 'Medical measurement '''||txt||' '||coalesce(unit, '')||''' is missing from simplified text' message from
 (select *, round(value, 2) v from ms where side='o' qualify row_number() over (partition by pair_id, round(value, 2) order by ord)=1) a
 where (v>3 or unit is not null) and not exists (select 1 from ms b where b.side='s' and b.pair_id=a.pair_id and round(b.value, 2)=a.v))"""


_UM = "MAP {" + ", ".join(f"{K.q(a)}: {K.q(b)}" for a, b in rules.UNIT_MAP.items()) + "}"
_OK = ", ".join(f"({K.q(a)}, {K.q(b)})" for a, b in rules.ALLOWED_UNIT_CHANGES)


def unit_sql(name: str = "v1b") -> str:
    return f"""un as materialized (select pair_id, side, value, round(value, 2) v, coalesce({_UM}[unit], unit) u from ms where unit is not null),
{name} as (select a.pair_id, 'UNIT_MISMATCH' code, 'CRITICAL' severity,
 'Unit changed from '''||a.u||''' to '''||b.u||''' for value '||a.value message
 from un a join un b on a.pair_id=b.pair_id and a.side='o' and b.side='s' and a.v=b.v and a.u<>b.u where (a.u, b.u) not in ({_OK}))"""


def flip_sql(src: str, name: str = "v1c") -> str:
    def has(c, side):
        return "(" + lat_sql(side).replace("lower(t)", f"lower({c})") + ")"
    return f"""{name} as (select pair_id, 'LATERALITY_FLIP' code, 'CRITICAL' severity, 'Laterality flipped: original says LEFT but simplified says RIGHT' message
 from {src} where {has('original', 'left')} and not {has('original', 'right')} and {has('simplified', 'right')} and not {has('simplified', 'left')}
 union all select pair_id, 'LATERALITY_FLIP', 'CRITICAL', 'Laterality flipped: original says RIGHT but simplified says LEFT'
 from {src} where {has('original', 'right')} and not {has('original', 'left')} and {has('simplified', 'left')} and not {has('simplified', 'right')})"""


def staged(df):
    return df.withColumns({"om": E.measurements(O()), "sm": E.measurements(S())})


@query("numeric_missing", f"with {NOTES_SQL}, {K.measurement_rows('notes')}, {missing_sql()} select * from v1a")
def v_missing(spark, d):
    return err_rows(staged(notes(spark, d)), validate.numeric_missing(F.col("om"), F.col("sm")), "code", "severity", "message")


@query("numeric_missing_reports", f"with {REPORTS_SQL}, {K.measurement_rows('reports')}, {missing_sql()} select * from v1a")
def v_missing_reports(spark, d):
    return err_rows(staged(reports(spark, d)), validate.numeric_missing(F.col("om"), F.col("sm")), "code", "severity", "message")


@query("unit_mismatch", f"with {NOTES_SQL}, {K.measurement_rows('notes')}, {unit_sql()} select * from v1b")
def v_unit(spark, d):
    return err_rows(staged(notes(spark, d)), validate.unit_mismatch(F.col("om"), F.col("sm")), "code", "severity", "message")


@query("laterality_flip", f"with {NOTES_SQL}, {flip_sql('notes')} select * from v1c")
def v_flip(spark, d):
    return err_rows(notes(spark, d), validate.laterality_flip(O(), S()), "code", "severity", "message")


# ------------------------------------------------------------------------- V2
def evidence_sql(src: str, ws_lower) -> str:
    return (f"ev as (select pair_id, original, simplified, unnest({EVIDENCE.replace('{t}', 'simplified')}) e from {src}),"
            f" v2 as (select pair_id, 'EVIDENCE_NOT_FOUND' code, 'HIGH' severity, case when len(e)>100 then left(e, 100)||'...' else e end summary_span"
            f" from ev where not contains({ws_lower('original')}, {ws_lower('e')}))")


WL = lambda x: f"lower({K.collapse(x)})"


@query("validate_evidence", f"""with {REPORTS_SQL}, {evidence_sql('reports', WL)},
cl as (select pair_id, unnest({claims_sql('simplified', EVIDENCE.replace('{t}', 'simplified'))}) e from reports)
select * from v2 union all select pair_id, 'CLAIM_WITHOUT_EVIDENCE', 'MEDIUM', case when len(e)>100 then left(e, 100)||'...' else e end from cl""")
def v_evidence(spark, d):
    return err_rows(reports(spark, d), validate.evidence(O(), S(), True), "code", "severity", "summary_span")


# quotes of benchmark passages checked against the documents' texts
_QUOTES = """quotes as (select item_id, text e from benchmark)"""


@query("evidence_quotes", f"with {_QUOTES} select doc_id, item_id from documents, quotes where contains({WL('text')}, {WL('e')})")
def evidence_quotes(spark, d):
    return quote_hits(spark, d, table(spark, d, "benchmark").select("item_id", "text"))


_PARTS = r"string_split_regex(trim(text), '\s+')"


@query("evidence_quotes_short", f"""with p as (select item_id, {_PARTS} w from benchmark),
quotes as (select item_id*2 item_id, array_to_string(w[1:2], ' ') e from p union all select item_id*2+1, w[len(w)] from p)
select doc_id, item_id from documents, quotes where contains({WL('text')}, {WL('e')})""")
def evidence_quotes_short(spark, d):
    """The first two words and the last word of each passage as quotes of their own."""
    w = F.split(F.trim("text"), r"\s+")
    both = F.array(F.array_join(F.slice(w, 1, 2), " "), F.element_at(w, -1))
    q = table(spark, d, "benchmark").select("item_id", F.posexplode(both).alias("k", "text"))
    return quote_hits(spark, d, q.select((F.col("item_id") * 2 + F.col("k")).alias("item_id"), "text"))


def quote_hits(spark, d, passages):
    """Which passages are verbatim (normalised) parts of which documents.

    The equi-join runs on one word sequence: every passage's first eight words
    against all eight-word windows of the texts; containment then verifies.
    """
    from ..functions.text import norm_ws_lower, words_ws
    n = 8
    gram = lambda w, i: F.array_join(F.slice(w, i, n), " ")
    q = passages.select("item_id", norm_ws_lower(F.col("text")).alias("quote"))
    q = q.withColumn("qw", words_ws(F.col("quote")))
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id", always=True).select(
        "doc_id", norm_ws_lower(F.col("text")).alias("doc"))
    dw = docs.withColumn("dw", words_ws(F.col("doc")))
    # interior words of a contained passage appear as whole words, the outer two may be cut
    inner = q.filter(F.size("qw") >= n + 2).select("item_id", "quote", F.xxhash64(gram(F.col("qw"), F.lit(2))).alias("g"))
    short = q.filter(F.size("qw") < n + 2).select("item_id", "quote")
    wins = dw.filter(F.size("dw") >= n).select("doc_id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("dw") - n + 1), lambda i: F.xxhash64(gram(F.col("dw"), i))))).alias("g"))
    cand = wins.join(inner.select("g").distinct(), "g", "left_semi").join(inner, "g").select("doc_id", "item_id", "quote")
    long_hits = cand.join(docs, "doc_id").filter(F.col("doc").contains(F.col("quote")))
    # passages under ten words: match on their longest interior word, then verify
    key = lambda w: F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    s_in = short.withColumn("w", key(F.slice(words_ws(F.col("quote")), F.lit(2), F.greatest(
        F.lit(0), F.size(words_ws(F.col("quote"))) - 2))))
    by_word = dw.select("doc_id", F.explode(F.array_distinct("dw")).alias("w")).join(s_in.filter("w is not null"), "w")
    edge = edge_hits(dw.select("doc_id", "dw"), s_in.filter("w is null and quote <> ''").select("item_id", "quote"))
    found = by_word.select("doc_id", "item_id", "quote")
    short_hits = found.join(docs, "doc_id").filter(F.col("doc").contains(F.col("quote")))
    return long_hits.select("doc_id", "item_id").unionByName(short_hits.select("doc_id", "item_id")).unionByName(edge)


def edge_hits(dw, quotes):
    """Documents whose word sequence ``dw`` holds a quote of one or two words, whose outer ends may be cut.

    Two steps, each an equi-join: the corpus' different words meet the quotes' first words by their pieces (any piece
    for a lone word, an ending for the first of two), then the texts' neighbouring words meet the words found. No text
    travels, and no pair of text and quote is made that the first word does not support.
    """
    q = quotes.withColumn("qw", F.split("quote", " ")).select(
        "item_id", F.element_at("qw", 1).alias("first"), F.try_element_at("qw", F.lit(2)).alias("second"))
    lone = F.col("second").isNull()
    # lengths that occur: one row per length, not per quote
    lengths = q.select(lone.alias("lone"), F.length("first").alias("n")).distinct()
    # as texts, which are told apart by hash; words hold no space
    pairs = let(F.col("dw"), lambda w: F.array_distinct(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))
    near = dw.select("doc_id", F.explode(pairs).alias("p")).withColumn("at", F.instr("p", " ")).select(
        "doc_id", F.when(F.col("at") == 0, F.col("p")).otherwise(F.expr("left(p, at - 1)")).alias("x"),
        F.when(F.col("at") > 0, F.expr("substring(p, at + 1)")).alias("y"))
    words = near.select("x").distinct()
    pieces = words.join(F.broadcast(lengths), F.length("x") >= F.col("n")).select("x", "lone", F.explode(F.when(
        F.col("lone"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x") - F.col("n") + 1), lambda i: F.substring(
            F.col("x"), i, F.col("n"))))).otherwise(F.array(F.right("x", F.col("n"))))).alias("first"))
    able = pieces.join(q.withColumn("lone", lone), ["lone", "first"]).select("x", "item_id", "second")
    hit = near.join(able, "x").filter(F.col("second").isNull() | F.coalesce(F.col("y").startswith(F.col("second")), F.lit(False)))
    return hit.select("doc_id", "item_id").distinct()


# ------------------------------------------------------------------------- V3
GR = GROUNDING_SQL.replace("lower(t)", "lower(simplified)")
GROUND = "v3 as (select pair_id, 'UMLS_HIGH_RISK_TERM' code, 'CRITICAL' severity, 'Dangerous diagnosis '''||x||''' introduced but not in original' message" \
         " from (select pair_id, original, unnest({gr}) x from {src}) where " + RISK + " and not contains(lower(original), x))"


@query("validate_grounding", f"with {NOTES_SQL}, {REPORTS_SQL}, {_MIXED}, {GROUND.format(gr=GR, src='mixed')} select * from v3")
def v_grounding(spark, d):
    return err_rows(mixed(spark, d), validate.grounding(O(), S()), "code", "severity", "message")


# --------------------------------------------------------- matched sentences (P1)
def feature_sql(src: str) -> str:
    """CTEs ``fo``/``fs``: sentences with word, number and drug sets; ``best``: the first best match."""
    drugs = K.norm_set("x", rules.DRUG_PATTERNS, lambda m: f"lower({m})")

    def side(name, col):
        return f"""{name} as (select pair_id, i-1 pos, a[i] x, list_distinct({K.words_ws('lower(a[i])')}) w,
 list_distinct(list_transform({K.find_all('a[i]', rules.NUMBER)}, lambda z: cast(z as double))) n, {drugs.replace('(x,', '(a[i],')} g from
 (select pair_id, a, unnest(range(1, len(a)+1)) i from (select pair_id, {K.expanded_sentences(col)} a from {src})))"""

    def jac(a, b):
        return f"coalesce(len(list_intersect({a}, {b}))/nullif(len({a})+len({b})-len(list_intersect({a}, {b})), 0), 0.0)"
    score = f"0.35*{jac('s.g', 'o.g')}+0.25*{jac('s.n', 'o.n')}+0.25*0.0+0.15*{jac('s.w', 'o.w')}"
    return f"""{side('fo', 'original')}, {side('fs', 'simplified')},
best as (select s.pair_id, s.pos, s.x sentence, o.pos match_pos, o.x "match", {score} score,
 list_has_any(s.g, o.g) or list_has_any(s.n, o.n) shares from fs s join fo o on s.pair_id=o.pair_id
 qualify row_number() over (partition by s.pair_id, s.pos order by score desc, o.pos)=1)"""


@query("best_sentence_match", f"with {NOTES_SQL}, {feature_sql('notes')} select pair_id, pos, sentence, match_pos, \"match\", round(score, 6) score from best where score>=0.3")
def best_match(spark, d):
    m = match.best_sentence_match(notes(spark, d))
    return m.filter("match_pos is not null").select("pair_id", "pos", "sentence", "match_pos", "match", exact_round(F.col("score"), 6).alias("score"))


@query("best_sentence_match_dialogue", f"with {DIALOGUE_SQL}, {feature_sql('dialogue')} select s.pair_id, s.pos, match_pos, round(coalesce(score, 0.0), 6) score"
       " from fs s left join best b on b.pair_id=s.pair_id and b.pos=s.pos and score>=0.02")
def best_match_dialogue(spark, d):
    m = match.best_sentence_match(dialogue(spark, d), 0.02)
    return m.select("pair_id", "pos", "match_pos", exact_round(F.col("score"), 6).alias("score"))


# ------------------------------------------------------- V4 (score table derived from the pairs)
_LAB = "case (pair_id+pos)%3 when 0 then 'contradiction' when 1 then 'entailment' else 'neutral' end"
_CONF = "0.5+((pair_id*7+pos*13)%50)/100.0"


def scores(m):
    """A score table for matched sentences."""
    return m.filter("(pair_id+pos)%10<>9").select("pair_id", F.col("pos").alias("hypothesis_pos"), F.expr(_LAB).alias("label"),
                                                  F.expr(f"cast({_CONF} as double)").alias("confidence"))


def scored(n):
    """Matches are stored first, as they are for a model: they are scored from there and joined to the scores from there."""
    m = cut(validate.matched_sentences(n))
    return validate.scored_matches(n, scores(m), matches=m)


SCORED = f"scored as (select *, case when (pair_id+pos)%10<>9 then {_LAB} else 'neutral' end as \"label\", case when (pair_id+pos)%10<>9 then {_CONF} else 0.5 end conf from best where score>=0.25)"


@query("validate_contradiction", f"with {NOTES_SQL}, {feature_sql('notes')}, {SCORED} select pair_id, pos, 'CONTRADICTION_DETECTED' code, 'CRITICAL' severity,"
       " sentence summary_span, \"match\" source_evidence from scored where \"label\"='contradiction' and conf>=0.85 and shares")
def v_contradiction(spark, d):
    return validate.contradictions(scored(notes(spark, d))).select("pair_id", "pos", "code", "severity", "summary_span", "source_evidence")


# ------------------------------------------------------------------------- V5
_PW = lambda x: f"list_distinct(list_filter({K.find_all(f'lower({x})', r'\w+')}, lambda w: not list_contains({K.words_list(rules.PREMISE_STOP_WORDS)}, w)))"


def premise_sql(src: str) -> str:
    return f"""so as (select pair_id, i-1 cpos, a[i] c, {_PW('a[i]')} cw from (select pair_id, a, unnest(range(1, len(a)+1)) i from
 (select pair_id, {K.lookbehind_sentences('original')} a from {src}))),
aw as (select *, {_PW('sentence')} qw from acts where side='s'),
prem as (select a.pair_id, a.rule, a.pos, c, len(list_intersect(qw, cw))/nullif(len(qw)+len(cw)-len(list_intersect(qw, cw)), 0) sc
 from aw a join so on so.pair_id=a.pair_id where len(list_intersect(qw, cw))>0
 qualify row_number() over (partition by a.pair_id, a.rule, a.pos order by sc desc, cpos)=1)"""


@query("best_premise", f"with {REPORTS_SQL}, {K.sides('reports')}, {action_rows('tx')}, {premise_sql('reports')}"
       " select a.pair_id, a.rule, a.pos, a.category, a.sentence, coalesce(p.c, left(r.original, 1000)) premise from acts a"
       " join reports r on r.pair_id=a.pair_id left join prem p on p.pair_id=a.pair_id and p.rule=a.rule and p.pos=a.pos where side='s'")
def best_premise(spark, d):
    return validate.action_premises(reports(spark, d)).select("pair_id", "rule", "pos", "category", "sentence", "premise")


def recommendation_sql() -> str:
    return "v5 as (select pair_id, 'UNSAFE_RECOMMENDATION' code, severity, 'Action sentence not supported by original (NLI: neutral, conf: 50.00%)' message, sentence from acts where side='s')"


SIMILARITY = f"""j as (select a.*, coalesce(p.c, left(r.original, 1000)) premise from acts a join {{src}} r on r.pair_id=a.pair_id
 left join prem p on p.pair_id=a.pair_id and p.rule=a.rule and p.pos=a.pos where side='s'),
k as (select *, list_distinct({K.words_ws('lower(premise)')}) pw, list_distinct({K.words_ws('lower(sentence)')}) sw from j),
advice as (select *, coalesce(len(list_intersect(pw, sw))/nullif(len(pw)+len(sw)-len(list_intersect(pw, sw)), 0), 0.0) sim from k)"""
# a percentage with two digits, rounded from its shortest decimal text, halves up
_PCT = "cast(cast(cast({x}*100 as varchar) as decimal(18,15)) as decimal(9,2))"


def similarity_score(premise, sentence):
    """The reference's score without an entailment model: bands of the texts' similarity."""
    return validate.similarity_bands(word_jaccard(premise, sentence))


@query("validate_recommendations", f"""with {NOTES_SQL}, {REPORTS_SQL}, {_MIXED}, {K.sides('mixed')}, {action_rows('tx')}, {premise_sql('mixed')}, {SIMILARITY.replace('{src}', 'mixed')},
n as (select *, case when sim>0.5 then 'neutral' else 'contradiction' end as nli, {_PCT.replace('{x}', '(case when sim>0.5 then 0.5 else 1.0-sim end)')} conf from advice where not sim>0.75)
select pair_id, 'UNSAFE_RECOMMENDATION' code, severity, 'Action sentence '||case nli when 'contradiction' then 'contradicts' else 'not supported by' end||' original (NLI: '||nli||', conf: '||conf||'%)' message,
 case when len(sentence)>150 then left(sentence, 150)||'...' else sentence end as summary_span from n""")
def v_recommend(spark, d):
    """Advice that its best premise does not entail; an exact sentence of the original is no error."""
    return err_rows(mixed(spark, d), validate.recommendations(O(), S(), similarity_score), "code", "severity", "message", "summary_span")


@query("validate_recommendations_similarity", f"""with {REPORTS_SQL}, {K.sides('reports')}, {action_rows('tx')}, {premise_sql('reports')},
j as (select a.*, coalesce(p.c, left(r.original, 1000)) premise from acts a join reports r on r.pair_id=a.pair_id
 left join prem p on p.pair_id=a.pair_id and p.rule=a.rule and p.pos=a.pos where side='s'),
k as (select *, list_distinct({K.words_ws('lower(premise)')}) pw, list_distinct({K.words_ws('lower(sentence)')}) sw from j),
l as (select *, coalesce(len(list_intersect(pw, sw))/nullif(len(pw)+len(sw)-len(list_intersect(pw, sw)), 0), 0.0) sim from k)
select pair_id, rule, pos, severity, case when sim>0.5 then 'neutral' else 'contradiction' end as "label" from l where not sim>0.75""")
def v_recommend_similarity(spark, d):
    p = validate.action_premises(reports(spark, d))
    e = validate.recommendations_scored(p, similarity_score)
    return e.select("pair_id", "rule", "pos", "severity", F.col("metadata")["nli_label"].alias("label"))


# ------------------------------------------------------------------------- V6
def safety_sql(src: str) -> str:
    a = " union all ".join(f"select pair_id, {i} k, {K.q(n)} kind, {x} a, {y} b from {src}" for i, ((n, x), (_, y)) in enumerate(
        zip(typed_sql("original"), typed_sql("simplified"))))
    return f"""ty as ({a}), tm as (select pair_id, k, kind, a, {K.fuzzy_missing('a', 'b')} miss from ty),
v6 as (select pair_id, coalesce((sum(len(a))-sum(len(miss)))/nullif(sum(len(a)), 0), 1.0) recall, sum(len(miss)) lost from tm group by 1)"""


def safety(df):
    return df.withColumn("z", validate.concept_safety(O(), S()))


@query("concept_safety", f"with {NOTES_SQL}, {REPORTS_SQL}, {_MIXED}, {safety_sql('mixed')} select pair_id, round(recall, 6) recall, recall>=0.7 as is_safe, recall<0.5 as needs_review, lost as missing from v6")
def v_safety(spark, d):
    return safety(mixed(spark, d)).select("pair_id", exact_round(F.col("z.recall"), 6).alias("recall"), "z.is_safe", "z.needs_review",
                                          F.size("z.missing").alias("missing"))


@query("concept_safety_errors", f"with {REPORTS_SQL}, {safety_sql('reports')}, it as (select pair_id, k, kind, unnest(miss) m from tm)"
       " select pair_id, 'Missing critical concept: ['||kind||'] '||m as message from it qualify row_number() over (partition by pair_id order by k, m)<=10")
def v_safety_errors(spark, d):
    return err_rows(safety(reports(spark, d)), validate.concept_safety_errors(F.col("z")), "message")


@query("concept_coverage_by_type", f"with {REPORTS_SQL}, {safety_sql('reports')} select kind, sum(len(a)-len(miss)) as found, sum(len(a)) as total from tm group by 1")
def v_safety_types(spark, d):
    z = safety(reports(spark, d)).select(F.explode(F.map_entries("z.coverage")).alias("e"))
    return z.groupBy(F.col("e.key").alias("kind")).agg(F.sum("e.value.found").alias("found"), F.sum("e.value.total").alias("total"))


@query("fuzzy_preserved", f"with {NOTES_SQL}, t as (select pair_id, {K.norm_set('original', rules.MEASUREMENT_PATTERNS, K.lower_collapse)} a,"
       f" {K.norm_set('simplified', rules.MEASUREMENT_PATTERNS, K.lower_collapse)} b from notes)"
       f" select pair_id, unnest({K.fuzzy_missing('a', 'b')}) as missing from t")
def v_fuzzy(spark, d):
    g = lambda c: E.extract_quality_group(c, "measurement")
    n = notes(spark, d).withColumns({"a": g(O()), "b": g(S())})
    return n.select("pair_id", F.explode(fuzzy_missing(F.col("a"), F.col("b"))).alias("missing"))


# ------------------------------------------------------------------------- V7
def _diff(a, b):
    return f"array_to_string(list_sort(list_filter(list_distinct({a}), lambda x: not list_contains({b}, x))), '|')"


def legacy_sql(src: str) -> str:
    pn = lambda c: K.find_all(c, rules.PLAIN_NUMBER)
    ng = lambda c: K.find_all(f"lower({c})", rules.NEGATION, "", 1)
    return (f"v7 as (select pair_id, {_diff(pn('original'), pn('simplified'))} number_missing, {_diff(pn('simplified'), pn('original'))} number_extra,"
            f" {_diff(ng('original'), ng('simplified'))} negation_missing from {src})")


def legacy_cols(c):
    return [F.array_join(c[n], "|").alias(n) for n in ("number_missing", "number_extra", "negation_missing")]


_KW = ["aspirin", "dose", "left", "stroke"]
_LOST = "array_to_string(list_filter(" + K.words_list(_KW) + ", lambda k: not regexp_matches(lower(simplified), '\\b'||k||'\\b')), '{sep}')"


def _set_text(c):
    return f"'{{'||replace({c}, '|', ', ')||'}}'"


@query("legacy_comparison", f"""with {NOTES_SQL}, {REPORTS_SQL}, {_MIXED}, {legacy_sql('mixed')}, k as (select pair_id, {_LOST.replace('{sep}', '|')} entity_missing from mixed)
select v7.*, entity_missing, 'Missing entities: '||{_set_text('entity_missing')}||chr(10)||'Extra entities: {{}}'||chr(10)||'Missing numbers: '||{_set_text('number_missing')}||chr(10)
 ||'Extra numbers: '||{_set_text('number_extra')}||chr(10)||'Missing negations: '||{_set_text('negation_missing')} as issues from v7 join k using (pair_id)""")
def v_legacy(spark, d):
    words = F.array(*[F.lit(w.title()) for w in _KW])
    n = mixed(spark, d).withColumn("c", validate.legacy_comparison(O(), S(), words))
    return n.select("pair_id", *legacy_cols(F.col("c")), F.array_join("c.entity_missing", "|").alias("entity_missing"), "c.issues")


# -------------------------------------------------------------------- V8 .. V11
def gates_sql(src: str) -> str:
    """CTE ``errs(pair_id, g, validator, code, severity)`` over the default gates."""
    return f"""{empty_sql(src)}, {K.measurement_rows(src)}, {missing_sql()}, {unit_sql()}, {flip_sql(src)},
{GROUND.format(gr=GR, src=src)}, {action_rows('tx')}, {recommendation_sql()}, {safety_sql(src)},
errs as (select pair_id, 'empty_chunk_validator' validator, code, severity, message from v0
 union all select pair_id, 'numeric_validator', code, severity, message from v1a union all select pair_id, 'numeric_validator', code, severity, message from v1b
 union all select pair_id, 'numeric_validator', code, severity, message from v1c union all select pair_id, 'umls_grounding_validator', code, severity, message from v3
 union all select pair_id, 'recommendation_policy_validator', code, severity, message from v5)"""


GATES = f"with {NOTES_SQL}, {gates_sql('notes')}"


@query("run_validators", f"{GATES} select n.pair_id, count(e.code)=0 as passed, count(e.code) as errors, v6.recall<0.5 as safety_review"
       " from notes n join v6 using (pair_id) left join errs e using (pair_id) group by n.pair_id, v6.recall")
def run_validators(spark, d):
    v = validate.run_validators(notes(spark, d))
    return v.select("pair_id", "passed", F.size(validate.all_errors(F.col("results"))).alias("errors"), "safety_review")


@query("run_validators_fast", f"{GATES} select validator, count(*) errors from errs where validator<>'umls_grounding_validator' group by 1")
def run_fast(spark, d):
    v = validate.run_validators(notes(spark, d), validate.FAST_GATES)
    return validate.error_rows(v).groupBy("validator").agg(F.count(F.lit(1)).alias("errors"))


@query("validation_summary", f"{GATES} select validator, code, severity, count(*) errors, count(distinct pair_id) pairs, severity in ('HIGH','CRITICAL') as hard from errs group by 1,2,3")
def summary(spark, d):
    return validate.validation_summary(validate.run_validators(notes(spark, d), safety=False))


@query("repair_prompt", f"{GATES} select pair_id, string_agg('['||code||'] '||message, '|' order by '['||code||'] '||message) as problems from errs group by 1")
def repair_prompt(spark, d):
    v = validate.run_validators(notes(spark, d), safety=False)
    # exploded out of one array: a filter on the prompt would be pushed below the gates and run them again
    made = F.filter(F.array(validate.repair_prompt(F.col("results"))), lambda p: p != "")
    p = v.select("pair_id", F.explode(once(made)).alias("p"))
    lines = F.regexp_extract_all("p", F.lit(r"(?m)^\d+\. (\[.*)$"), F.lit(1))
    return p.select("pair_id", F.array_join(F.array_sort(lines), "|").alias("problems"))


@query("validate_with_retry", f"{GATES} select n.pair_id, count(e.code)>0 as should_repair, v6.recall<0.5 as needs_review"
       " from notes n join v6 using (pair_id) left join errs e using (pair_id) group by n.pair_id, v6.recall")
def with_retry(spark, d):
    return validate_with_retry(notes(spark, d)).select("pair_id", "should_repair", "needs_review")


# deterministic repair: fall back to the original text; the second round then validates (original, original)
@query("iterate_until_valid", f"""with {NOTES_SQL}, {gates_sql('notes')}, bad as (select distinct pair_id from errs),
l2 as (select pair_id, original, original simplified from notes join bad using (pair_id)),
r2 as (select pair_id from ({{second}}))
select n.pair_id, case when n.pair_id not in (select pair_id from bad) then 1 when n.pair_id in (select pair_id from r2) then 3 else 2 end as iteration,
 n.pair_id in (select pair_id from r2) as needs_review from notes n""".replace(
    "{second}", f"with notes as (select * from l2), {gates_sql('notes')} select distinct pair_id from errs"))
def iterate(spark, d):
    out = iterate_until_valid(notes(spark, d), lambda df: F.col("original"), 3, safety=False)
    return out.select("pair_id", "iteration", "needs_review")


@query("legacy_fix_loop", f"with {NOTES_SQL}, {legacy_sql('notes')} select pair_id, case when number_missing='' and number_extra='' and negation_missing='' then 1 else 2 end as iteration, true as clean from v7")
def legacy_loop(spark, d):
    out = legacy_fix_loop(notes(spark, d), lambda df: F.col("original"), 5)
    return out.select("pair_id", "iteration", "clean")




# ------------------------------------------------------- null texts and supplied errors
NULLED_SQL = "nulled as (select pair_id, case when pair_id%5<>0 then original end o, case when pair_id%7<>0 then simplified end s from notes), mixed as (select pair_id, coalesce(o, '') original, coalesce(s, '') simplified from nulled)"


def nulled(spark, d):
    """The note pairs with the original of every fifth and the rewrite of every seventh lost."""
    return notes(spark, d).select("pair_id", F.when(F.col("pair_id") % 5 != 0, O()).alias("original"),
                                  F.when(F.col("pair_id") % 7 != 0, S()).alias("simplified"))


@query("null_pairs_gates", f"with {NOTES_SQL}, {NULLED_SQL}, {gates_sql('mixed')} select n.pair_id, count(e.code)=0 as passed, count(e.code) as errors, v6.recall<0.5 as safety_review"
       " from notes n join v6 using (pair_id) left join errs e using (pair_id) group by n.pair_id, v6.recall")
def null_gates(spark, d):
    v = validate.run_validators(nulled(spark, d))
    return v.select("pair_id", "passed", F.size(validate.all_errors(F.col("results"))).alias("errors"), "safety_review")


@query("null_pairs_legacy_loop", f"with {NOTES_SQL}, {NULLED_SQL}, {legacy_sql('mixed')} select pair_id, case when number_missing='' and number_extra='' and negation_missing='' then 1 else 2 end as iteration, true as clean from v7")
def null_loop(spark, d):
    out = legacy_fix_loop(nulled(spark, d), lambda df: F.col("original"), 5)
    return out.select("pair_id", "iteration", "clean")


@query("run_validators_supplied", f"""{GATES}, x as (select pair_id, 'umls_grounding_validator' validator, 'UMLS_CUI_INTRODUCED' code, 'C'||(pair_id%9) cui from notes where pair_id%4=0
 union all select pair_id, 'my_model_gate', 'UNGROUNDED_ADVICE', null from notes where pair_id%6=0),
a as (select pair_id, validator, code, null cui from errs union all select * from x)
select pair_id, validator, count(*) as errors, string_agg(cui, ',') as cuis from a group by 1, 2""")
def supplied(spark, d):
    """Errors of a gate and of a validator of the caller's, with metadata, beside the built-in ones."""
    n = notes(spark, d)
    extra = n.filter("pair_id % 4 = 0").select(
        "pair_id", F.lit("umls_grounding_validator").alias("validator"), F.lit("UMLS_CUI_INTRODUCED").alias("code"),
        F.create_map(F.lit("cui"), F.concat(F.lit("C"), (F.col("pair_id") % 9).cast("string"))).alias("metadata"))
    extra = extra.unionByName(n.filter("pair_id % 6 = 0").select(
        "pair_id", F.lit("my_model_gate").alias("validator"), F.lit("UNGROUNDED_ADVICE").alias("code"),
        F.lit(None).cast("map<string,string>").alias("metadata")))
    v = validate.run_validators(n, safety=False, extra_errors=extra, supplied=("my_model_gate",))
    e = validate.error_rows(v)
    return e.groupBy("pair_id", "validator").agg(F.count(F.lit(1)).alias("errors"), F.max(F.col("metadata")["cui"]).alias("cuis"))

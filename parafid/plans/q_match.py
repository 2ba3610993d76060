"""Queries: similarity, fact alignment, citations' sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rx import once
from ..functions.sets import cosine, exact_round, jaccard, word_jaccard
from ..functions.text import words_ws
from ..operators import match, terms
from . import sqlkit as K
from .fixtures import DIALOGUE_SQL, NOTES_SQL, dialogue, notes, spread, table
from .registry import query

JAC = "coalesce(len(list_intersect(a, b))/nullif(len(a)+len(b)-len(list_intersect(a, b)), 0), 0.0)"


@query("jaccard", f"with {DIALOGUE_SQL}, w as (select pair_id, list_distinct({K.words_ws('lower(original)')}) a, list_distinct({K.words_ws('lower(simplified)')}) b from dialogue) select pair_id, round({JAC}, 6) similarity from w")
def q_jaccard(spark, d):
    w = dialogue(spark, d).select("pair_id", F.array_distinct(words_ws(F.lower("original"))).alias("a"),
                                  F.array_distinct(words_ws(F.lower("simplified"))).alias("b"))
    return w.select("pair_id", exact_round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("sentence_similarity", f"with {NOTES_SQL}, w as (select pair_id, list_distinct({K.words_ws('lower(original)')}) a, list_distinct({K.words_ws('lower(simplified)')}) b from notes) select pair_id, round({JAC}, 6) similarity from w")
def q_sentence_similarity(spark, d):
    return notes(spark, d).select("pair_id", exact_round(word_jaccard(F.col("original"), F.col("simplified")), 6).alias("similarity"))


@query("cosine_similarity", "select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) similarity from embeddings a join embeddings b on b.vec_id=a.vec_id+1")
def q_cosine(spark, d):
    e = spread(table(spark, d, "embeddings").select("vec_id", "embedding"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", exact_round(cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


# token vectors: every five consecutive vectors form one text; text k is compared with text k+1
_TEXTS = "tv as (select vec_id//5 t, vec_id, cast(embedding as double[]) e from embeddings)"


@query("greedy_embedding_match", f"""with {_TEXTS}, c as (select a.t, a.vec_id x, b.vec_id y, list_cosine_similarity(a.e, b.e) s from tv a join tv b on b.t=a.t+1),
p as (select t, avg(m) p from (select t, x, max(s) m from c group by 1,2) group by 1), r as (select t, avg(m) r from (select t, y, max(s) m from c group by 1,2) group by 1)
select t as pair_id, round(p, 5) "precision", round(r, 5) recall, round(coalesce(2*p*r/nullif(p+r, 0), 0.0), 5) f1 from p join r using (t)""")
def q_greedy(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 5).cast("long").alias("pair_id"), "vec_id", "embedding")
    g = spread(e, "pair_id").groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))),
                                                                lambda x: x["embedding"]).alias("candidate"))
    nxt = g.select((F.col("pair_id") - 1).alias("pair_id"), F.col("candidate").alias("reference"))
    m = match.greedy_embedding_match(g.join(nxt, "pair_id"))
    return m.select("pair_id", *[exact_round(F.col(c), 5).alias(c) for c in ("precision", "recall", "f1")])


# ------------------------------------------------------------------ facts: one per sentence of a note
_ASSERT = "case when contains({t}, 'stroke') then 'absent' when contains({t}, 'may be') then 'possible' else 'present' end"


def _facts(text, prefix):
    s = F.filter(F.transform(F.split(text, r"\."), F.trim), lambda x: x != "")
    kind = lambda t: F.when(t.contains("stroke"), "absent").when(t.contains("may be"), "possible").otherwise("present")
    return F.transform(s, lambda t, i: F.struct(
        F.concat(F.lit(prefix + "_"), (i + 1).cast("string")).alias("id"), t.alias("text"), F.lit("finding").alias("category"),
        kind(t).alias("assertion"), F.lower(t).alias("normalized")))


def facts(spark, d):
    """One row per note: source and summary facts as the model would return them."""
    n = notes(spark, d)
    return n.select(F.col("pair_id").alias("doc_id"), _facts(F.col("original"), "src").alias("source_props"),
                    _facts(F.col("simplified"), "sum").alias("summary_props"))


_KEY = "MAP {" + ", ".join(f"{K.q(t)}: {K.q(min(g, key=len))}" for g in rules.FALLBACK_SYNONYMS for t in g if " " not in t) + "}"
_DIG = "MAP {" + ", ".join(f"{K.q(a)}: {K.q(b)}" for a, b in rules.NUMBER_WORDS.items()) + "}"


def _wset(x):
    return f"list_distinct(list_transform({K.words_ws('regexp_replace(lower(' + x + '), ' + K.rx('[^\\w\\s-]') + ', ' + K.q('') + ', ' + K.q('g') + ')')}, lambda w: coalesce({_DIG}[w], w)))"


def facts_sql() -> str:
    def side(name, col, prefix):
        return f"""{name} as (select doc_id, {K.q(prefix)}||i id, i pos, x, {_ASSERT.format(t='x')} asr, {_wset('x')} w, list_transform({_wset('x')}, lambda z: coalesce({_KEY}[z], z)) k from
 (select pair_id doc_id, a[i] x, i from (select pair_id, a, unnest(range(1, len(a)+1)) i from (select pair_id, list_filter(list_transform(string_split({col}, '.'), lambda z: trim(z)), lambda z: z<>'') a from notes))))"""
    dice = "(len(list_filter(s.k, lambda z: list_contains(o.k, z)))+len(list_filter(o.k, lambda z: list_contains(s.k, z))))/nullif(len(s.w)+len(o.w), 0)"
    return f"""{NOTES_SQL}, {side('fo', 'original', 'src_')}, {side('fs', 'simplified', 'sum_')},
al as (select s.doc_id, s.id sid, s.pos spos, s.asr sasr, o.id oid, o.asr oasr, {dice} sim from fs s join fo o using (doc_id) where {dice}>=0.3
 qualify row_number() over (partition by s.doc_id, s.id order by sim desc, o.pos)<=3),
ag as (select doc_id, sid, string_agg(oid, '|' order by sim desc, cast(substr(oid, 5) as int)) source_ids, max(sim) confidence, arg_min(oasr, struct_pack(a := -sim, b := cast(substr(oid, 5) as int))) oasr from al group by 1,2)"""


@query("align_propositions", f"""with {facts_sql()} select f.doc_id, f.id summary_id, coalesce(source_ids, '') source_ids, round(coalesce(confidence, 0.0), 6) confidence,
 case when confidence is null then 'none' when confidence>0.8 then 'exact' when confidence>0.5 then 'semantic' else 'partial' end match_type from fs f left join ag on ag.doc_id=f.doc_id and ag.sid=f.id""")
def q_align(spark, d):
    a = match.align_propositions(facts(spark, d)).select("doc_id", F.inline(once(F.col("alignments"))))
    return a.select("doc_id", "summary_id", F.array_join("source_ids", "|").alias("source_ids"),
                    exact_round(F.col("confidence"), 6).alias("confidence"), "match_type")


_FLIP = "case when doc_id%3=0 then case asr when 'present' then 'absent' else 'present' end else asr end"


@query("assertion_mismatches", f"with {facts_sql()} select f.doc_id, f.id summary_id, {_FLIP.replace('doc_id', 'f.doc_id')} summary_assertion, oasr source_assertion from fs f join ag on ag.doc_id=f.doc_id and ag.sid=f.id where confidence>0.5 and {_FLIP.replace('doc_id', 'f.doc_id')}<>oasr")
def q_mismatch(spark, d):
    """In every third pair the rewrite says the opposite of what its facts say."""
    f = facts(spark, d)
    flipped = F.transform("summary_props", lambda p: p.withField("assertion", F.when(p["assertion"] == "present", "absent").otherwise("present")))
    f = f.withColumn("summary_props", F.when(F.col("doc_id") % 3 == 0, flipped).otherwise(F.col("summary_props")))
    return match.assertion_mismatches(match.align_propositions(f)).select(
        "doc_id", "summary_id", "summary_assertion", "source_assertion")


@query("linkage_report", f"""with {facts_sql()}, mo as (select distinct doc_id, oid from al)
select n.pair_id doc_id, (select count(*) from fo where fo.doc_id=n.pair_id) total_source_props, (select count(*) from fs where fs.doc_id=n.pair_id) total_summary_props,
 (select count(*) from mo where mo.doc_id=n.pair_id) matched_source_props, (select count(*) from fs where fs.doc_id=n.pair_id and not exists (select 1 from ag where ag.doc_id=fs.doc_id and ag.sid=fs.id)) unsupported_summary_props,
 round(coalesce((select count(*) from mo where mo.doc_id=n.pair_id)/nullif((select count(*) from fo where fo.doc_id=n.pair_id), 0), 1.0), 4) coverage_score,
 coalesce((select string_agg(id, '|' order by pos) from fo where fo.doc_id=n.pair_id and id not in (select oid from mo where mo.doc_id=n.pair_id)), '') missing,
 coalesce((select string_agg(id||':'||x, '|' order by pos) from fs where fs.doc_id=n.pair_id and not exists (select 1 from ag where ag.doc_id=fs.doc_id and ag.sid=fs.id)), '') unsupported from notes n""")
def q_linkage(spark, d):
    r = match.linkage_report(match.align_propositions(facts(spark, d)))
    return r.select("doc_id", "total_source_props", "total_summary_props", "matched_source_props", "unsupported_summary_props", "coverage_score",
                    F.array_join("missing_facts.id", "|").alias("missing"), F.array_join(F.transform(
                        "potential_hallucinations", lambda p: F.concat_ws(":", p["id"], F.trim(p["text"]))), "|").alias("unsupported"))


_DT1 = "'No sign of '||p_name||' seen, doctor recommends CT scan'"
_DT2 = "case when p_size%2=0 then 'Physician advised a ct scan: without '||p_name else 'Two '||p_name||' are absent' end"


def _fold_words(col):
    """Normalised words of the text and of its canonical form (phrases of the fixed groups replaced first)."""
    return f"list_distinct(list_concat({_wset(col)}, {_wset(col + 'c')}))"


def _canon(x):
    known = sorted(((t, min(g, key=len)) for g in rules.FALLBACK_SYNONYMS for t in g), key=lambda p: -len(p[0].split()))
    out = f"' '||{x}||' '"
    for t, c in known:
        if t != c and t in ("no sign of", "ct scan"):
            out = f"regexp_replace({out}, {K.q('(?i) ' + t + ' ')}, {K.q(' ' + c + ' ')}, 'g')"
    for t, c in known:
        if t != c and " " not in t:
            out = f"regexp_replace({out}, {K.q('(?i) ' + t + ' ')}, {K.q(' ' + c + ' ')}, 'g')"
    return f"trim({out})"


@query("dice_similarity", f"""with t as (select p_partkey, {_DT1} x, {_DT2} y from part), u as (select *, {_canon('x')} xc, {_canon('y')} yc from t),
w as (select p_partkey, {_fold_words('x')} a, {_fold_words('y')} b from u), k as (select *, list_transform(a, lambda z: coalesce({_KEY}[z], z)) ka, list_transform(b, lambda z: coalesce({_KEY}[z], z)) kb from w)
select p_partkey, round((len(list_filter(ka, lambda z: list_contains(kb, z)))+len(list_filter(kb, lambda z: list_contains(ka, z))))/(len(a)+len(b)), 6) similarity from k""")
def q_dice(spark, d):
    t = spread(table(spark, d, "part")).select("p_partkey", F.expr(_DT1).alias("x"), F.expr(_DT2).alias("y"))
    return t.select("p_partkey", exact_round(match.dice_similarity(
        F.col("x"), F.col("y"), terms.fallback_canonicalize), 6).alias("similarity"))


_PJ = ("case when turn%4=0 then '[{\"text\": \"Fact '||conv_id||'\", \"assertion\": \"absent\"}, {\"category\": \"anatomy\", \"normalized\": \"x\"}]'"
       " when turn%4=1 then 'Here: [{\"text\": \"Other\"}] done' when turn%4=2 then 'no facts' else '{\"text\": \"Single\"}' end")


@query("parse_propositions", f"""with t as (select conv_id, turn, turn%4 k from conversations)
select conv_id, turn, 'src_1' id, case k when 0 then 'Fact '||conv_id when 1 then 'Other' else 'Single' end "text", 'finding' category, case k when 0 then 'absent' else 'present' end assertion,
 lower(case k when 0 then 'Fact '||conv_id when 1 then 'Other' else 'Single' end) normalized from t where k<>2 union all select conv_id, turn, 'src_2', '', 'anatomy', 'present', 'x' from t where k=0""")
def q_parse(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_PJ).alias("j"))
    return t.select("conv_id", "turn", F.inline(match.parse_propositions(F.col("j"), "src")))

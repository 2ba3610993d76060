"""Queries: terminology build and lookup."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import postings, terms, validate
from . import sqlkit as K
from .checkpoints import checkpoint_dir, cut
from .fixtures import (CONSO_SQL, DEF_SQL, REPORTS_SQL, STY_SQL, SYN_SQL, mrconso, mrdef, mrsty, reports, spread, table)
from .q_evaluate import PART_PAIRS_SQL, gazetteer_sql, part_pairs, part_synonyms
from .q_extract import GROUNDING_SQL, RISK
from .registry import query

STY_AGG = "sa as (select CUI cui, string_agg(TUI, '|' order by ord) tuis from sty group by 1)"


@query("semantic_types_by_cui", f"with {STY_SQL} select CUI cui, string_agg(TUI||':'||STY, '|' order by ord) types from sty group by 1")
def q_types(spark, d):
    t = terms.semantic_types_by_cui(mrsty(spark, d))
    return t.select("cui", F.array_join(F.transform("semantic_types", lambda x: F.concat_ws(":", x["tui"], x["sty"])), "|").alias("types"))


DEFS = """dd as (select CUI cui, DEF, min(ord) ord from def where SUPPRESS<>'Y' and DEF<>'' group by 1,2),
da as (select cui, string_agg(DEF, '|' order by ord) definitions from dd group by 1)"""


@query("definitions_by_cui", f"with {DEF_SQL}, {DEFS} select * from da")
def q_defs(spark, d):
    return terms.definitions_by_cui(mrdef(spark, d)).select("cui", F.array_join("definitions", "|").alias("definitions"))


def concepts(spark, d, languages=None):
    return terms.build_concepts(mrconso(spark, d), terms.semantic_types_by_cui(mrsty(spark, d)),
                                terms.definitions_by_cui(mrdef(spark, d)), languages)


CONCEPTS = f"""{CONSO_SQL}, {STY_SQL}, {DEF_SQL}, {DEFS}, {STY_AGG},
act as (select * from conso where SUPPRESS<>'Y'),
cc as (select CUI cui, string_agg(distinct STR, '|' order by STR) terms, string_agg(distinct SAB, '|' order by SAB) sources, string_agg(distinct LAT, '|' order by LAT) languages,
 coalesce(arg_min(STR, ord) filter (TS='P' and ISPREF='Y' and LAT='ENG'), min(STR)) preferred_term from act group by 1)"""


@query("build_concepts", f"with {CONCEPTS} select cui, preferred_term, terms, sources, languages, coalesce(definitions, '') definitions, coalesce(tuis, '') tuis from cc left join da using (cui) left join sa using (cui)")
def q_concepts(spark, d):
    c = concepts(spark, d)
    return c.select("cui", "preferred_term", *[F.array_join(x, "|").alias(x) for x in ("terms", "sources", "languages", "definitions")],
                    F.array_join(F.transform("semantic_types", lambda t: t["tui"]), "|").alias("tuis"))


@query("build_concepts_spanish", f"with {CONSO_SQL} select CUI cui, min(STR) preferred_term, count(distinct STR) terms from conso where SUPPRESS<>'Y' and LAT='SPA' group by 1")
def q_concepts_spa(spark, d):
    c = terms.build_concepts(mrconso(spark, d), languages=["SPA"])
    return c.select("cui", "preferred_term", F.size("terms").cast("long").alias("terms"))


@query("build_synonyms", f"with {CONSO_SQL}, {SYN_SQL}, {STY_SQL}, {STY_AGG} select cui, term, term_lower, is_preferred, language, source, term_type, coalesce(tuis, '') tuis from syn left join sa using (cui)")
def q_synonyms(spark, d):
    s = part_synonyms(spark, d)
    return s.select("cui", "term", "term_lower", "is_preferred", "language", "source", "term_type", F.array_join("semantic_types", "|").alias("tuis"))


@query("get_concept", f"with {CONCEPTS}, want as (select distinct 'C'||lpad(cast(p_size as varchar), 7, '0') cui from part) select cui, preferred_term from want left join cc using (cui)")
def q_get_concept(spark, d):
    want = table(spark, d, "part").select(F.concat(F.lit("C"), F.lpad(F.col("p_size").cast("string"), 7, "0")).alias("cui"))
    return terms.get_concept(want, concepts(spark, d)).select("cui", "preferred_term")


@query("terminology_counts", f"with {CONSO_SQL}, {SYN_SQL} select 'synonyms' \"table\", count(*) \"rows\" from syn union all select 'concepts', count(distinct CUI) from conso where SUPPRESS<>'Y'")
def q_counts(spark, d):
    return terms.table_counts(concepts=concepts(spark, d), synonyms=part_synonyms(spark, d))


# --------------------------------------------------------------------- lookups
_TERM = "case p_size%4 when 0 then p_name when 1 then upper(p_name) when 2 then split_part(p_name, ' ', 2) else split_part(p_name, ' ', 1)||' '||lower(p_type) end"
QT = f"qt as (select distinct {_TERM} term from part)"


def query_terms(spark, d):
    return cut(table(spark, d, "part").select(F.expr(_TERM).alias("term")).distinct())


def lookup_sql(min_score: float, limit: int) -> str:
    """CTE ``lk(term, rank, score, cui, syn_term)``: the score evaluated for every pair sharing a token."""
    tok = lambda x: f"list_filter(string_split_regex(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w<>'')"
    return f"""{CONSO_SQL}, {SYN_SQL}, {QT}, sy as (select *, {tok('term')} st from syn), st as (select count(*) n, avg(len(st)) avgdl from sy),
dfs as (select token, count(*) df from (select unnest(list_distinct(st)) token from sy) group by 1),
qk as (select term, trim(lower(term)) ql, {tok('term')} qt from qt), qtok as (select term, unnest(list_distinct(qt)) token from qk),
tf as (select cui, term_lower, token, count(*) tf from (select cui, term_lower, unnest(st) token from sy) group by 1,2,3),
bm as (select qtok.term, cui, term_lower, sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len(st)/avgdl))) b from qtok join tf using (token) join dfs using (token) join sy using (cui, term_lower), st group by 1,2,3),
sc as (select term, b.cui, b.term_lower, s.term syn_term, s.is_preferred, s.ord, b + case when ql=b.term_lower then 10.0 else 0.0 end
 + case when contains(' '||array_to_string(st, ' ')||' ', ' '||array_to_string(qt, ' ')||' ') then 5.0 else 0.0 end score from bm b join qk using (term) join sy s on s.cui=b.cui and s.term_lower=b.term_lower),
lk as (select *, row_number() over (partition by term order by round(score, 9) desc, is_preferred desc, ord, cui) rank from sc where score>{min_score} qualify rank<={limit})"""


@query("lookup_terms", f"with {lookup_sql(0, 5)} select term, rank, cui, syn_term, round(score, 5) score from lk")
def q_lookup(spark, d):
    from ..functions.sets import exact_round
    r = terms.lookup_terms(query_terms(spark, d), part_synonyms(spark, d), 5)
    return r.select("term", "rank", "cui", "syn_term", exact_round(F.col("score"), 5).alias("score"))


@query("lookup_terms_threshold", f"with {lookup_sql(5, 3)} select term, rank, cui, syn_term, round(score, 5) score from lk")
def q_lookup5(spark, d):
    from ..functions.sets import exact_round
    r = terms.lookup_terms(query_terms(spark, d), part_synonyms(spark, d), 3, 5.0)
    return r.select("term", "rank", "cui", "syn_term", exact_round(F.col("score"), 5).alias("score"))


# the same lookup from an index that the query stores first
@query("lookup_terms_index", f"with {lookup_sql(0, 5)} select term, rank, cui, syn_term, round(score, 5) score from lk")
def q_lookup_index(spark, d):
    from ..functions.sets import exact_round
    index = postings.write_index(part_synonyms(spark, d), f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", 8)
    r = terms.lookup_terms(query_terms(spark, d), index, 5)
    return r.select("term", "rank", "cui", "syn_term", exact_round(F.col("score"), 5).alias("score"))


_CONC = CONCEPTS.replace(CONSO_SQL + ", ", "")


@query("canonical_of", f"with {lookup_sql(5, 1)}, {_CONC} select t.term, l.cui, preferred_term from qt t left join lk l using (term) left join cc using (cui)")
def q_canonical(spark, d):
    return terms.canonical_of(query_terms(spark, d), part_synonyms(spark, d), concepts(spark, d))


@query("synonyms_of", f"with {lookup_sql(0, 1)}, nt as (select distinct CUI cui, {K.collapse('lower(STR)')} s from conso where SUPPRESS<>'Y')"
       " select l.term, l.cui, string_agg(s, '|' order by s) synonyms from lk l join nt using (cui) group by 1,2")
def q_synonyms_of(spark, d):
    s = terms.synonyms_of(query_terms(spark, d), part_synonyms(spark, d), concepts(spark, d))
    return s.select("term", "cui", F.array_join("synonyms", "|").alias("synonyms"))


@query("semantic_types_of", f"with {lookup_sql(0, 1)}, {STY_SQL}, {STY_AGG} select l.term, l.cui, coalesce(tuis, '') tuis from lk l left join sa using (cui)")
def q_types_of(spark, d):
    s = terms.semantic_types_of(query_terms(spark, d), part_synonyms(spark, d))
    return s.select("term", "cui", F.array_join("semantic_types", "|").alias("tuis"))


_T2 = "case when p_partkey%3=0 then upper(p_name) when p_partkey%3=1 then 'ct scan' else 'widget' end"
_T1 = "case when p_partkey%5=0 then 'CT' else p_name end"


@query("are_synonyms", f"""with {lookup_sql(0, 1).replace(QT, f"pp as (select distinct {_T1} term1, {_T2} term2 from part), qt as (select term1 term from pp union select term2 from pp)")}
select p.*, lower(term1)=lower(term2) or coalesce(a.cui=b.cui, false) or (lower(term1)='ct' and lower(term2)='ct scan') are_synonyms from pp p left join lk a on a.term=term1 left join lk b on b.term=term2""")
def q_are_synonyms(spark, d):
    p = table(spark, d, "part").select(F.expr(_T1).alias("term1"), F.expr(_T2).alias("term2")).distinct()
    return terms.are_synonyms(p, part_synonyms(spark, d))


FB = "fb as (select * from (values " + ", ".join(f"({K.q(t)}, {K.q(min(g, key=len))}, {i})" for i, g in enumerate(
    rules.FALLBACK_SYNONYMS) for t in g) + ") v(term, canonical, g))"
_FBT = "case p_size%7 when 0 then 'WNL' when 1 then ' Both sides ' when 2 then 'advise' when 3 then 'doctors' when 4 then 'cat scan' when 5 then 'not seen' else p_name end"


@query("fallback_synonyms", f"with {FB}, t as (select distinct {_FBT} word from part) select word, canonical, (select count(*) from fb x where x.g=fb.g) group_size from t left join fb on term=trim(lower(word))")
def q_fallback(spark, d):
    t = table(spark, d, "part").select(F.expr(_FBT).alias("word")).distinct()
    n = F.size(terms.fallback_group(F.col("word")))
    return t.select("word", terms.fallback_canonical(F.col("word")).alias("canonical"), F.when(n > 0, n.cast("long")).otherwise(F.lit(0)).alias("group_size"))


@query("expand_with_synonyms", f"""with {FB}, t as (select p_partkey doc_id, {_FBT} word from part),
sy as (select p_name term, p_brand s from part), known as (select distinct term from sy)
select distinct doc_id, e expanded from (select doc_id, word e from t union all select doc_id, s from t join sy on sy.term=word
 union all select doc_id, y.term from t join fb x on x.term=trim(lower(word)) join fb y on y.g=x.g where word not in (select term from known))""")
def q_expand(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("doc_id"), F.expr(_FBT).alias("word"))
    syn = p.groupBy(F.col("p_name").alias("term")).agg(F.collect_set("p_brand").alias("synonyms"))
    return terms.expand_with_synonyms(t, syn)


# canonicalisation: names of synonyms replaced by the concept's preferred term, then the fixed groups
_CT = "'Use '||p_name||' WITHIN normal limits and '||p_name||' no sign of wear, cat scan '||p_type"
CANON = f"""{CONCEPTS}, dict as (select STR phrase, arg_min(preferred_term, a.CUI) v from act a join cc on cc.cui=a.CUI group by 1)"""


def walk_sql(name: str, src: str, dict_: str, max_n: int, lower: bool) -> str:
    """CTE ``name(id, txt)``: greedy longest replacement, one word position after the other."""
    cases = " ".join(f"when {dict_}_{n}.v is not null then {n}" for n in range(max_n, 0, -1))
    vals = " ".join(f"when {dict_}_{n}.v is not null then {dict_}_{n}.v" for n in range(max_n, 0, -1))
    ph = lambda n: f"array_to_string(r.w[r.i:r.i+{n - 1}], ' ')"
    joins = " ".join(f"left join {dict_} {dict_}_{n} on {dict_}_{n}.phrase={('lower(' + ph(n) + ')') if lower else ph(n)} and r.i+{n - 1}<=len(r.w)" for n in range(max_n, 0, -1))
    return f"""{name} as (with recursive r as (select id, {K.words_ws('txt')} w, 1 i, cast([] as varchar[]) out from {src}
 union all select r.id, r.w, r.i + case {cases} else 1 end, list_append(r.out, case {vals} else r.w[r.i] end) from r {joins} where r.i<=len(r.w))
 select id, array_to_string(out, ' ') txt from r where i>len(w))"""


@query("canonicalize", f"with {CANON}, {FB}, fd as (select term phrase, canonical v from fb), src as (select p_partkey id, {_CT} txt from part), {walk_sql('c1', 'src', 'dict', 3, False)}, {walk_sql('c2', 'c1', 'fd', 4, True)}"
       " select id p_partkey, txt as canonical_text from c2")
def q_canonicalize(spark, d):
    c = concepts(spark, d).select("cui", "preferred_term")
    rows = mrconso(spark, d).filter("SUPPRESS <> 'Y'").select(F.col("CUI").alias("cui"), F.col("STR").alias("phrase"))
    dictionary = rows.join(c, "cui").groupBy("phrase").agg(F.min_by("preferred_term", "cui").alias("value"))
    t = table(spark, d, "part").select("p_partkey", F.expr(_CT).alias("txt"))
    return terms.canonicalize(t, "txt", dictionary, keys=("p_partkey",)).select("p_partkey", "canonical_text")


# ------------------------------------------------------------ mentions and ranks
@query("is_medical_term", f"with {PART_PAIRS_SQL}, {gazetteer_sql('pairs')} select p.pair_id, count(m.cui)>0 as medical, arg_min(m.cui, m.pos) as first_cui from pairs p left join (select * from men where side='s') m using (pair_id) group by 1")
def q_is_medical(spark, d):
    m = terms.mentions(part_pairs(spark, d), "simplified", part_synonyms(spark, d), keys=("pair_id",))
    first = terms.entity_type(F.col("_mentions"), lambda tuis: F.try_element_at(F.col("_mentions"), F.lit(1))["cui"])
    return m.select("pair_id", terms.is_medical_term(F.col("_mentions")).alias("medical"), first.alias("first_cui"))


@query("rank_concepts", f"""with {PART_PAIRS_SQL}, {gazetteer_sql('pairs')}, {STY_SQL},
hi as (select distinct CUI cui from sty where TUI in ({', '.join(K.q(t) for t in rules.IMPORTANT_TYPES)})),
m1 as (select pair_id, phrase, cui, pos from men where side='o' qualify row_number() over (partition by pair_id, phrase order by pos)=1),
m2 as (select pair_id, phrase, m1.cui, pos, case when hi.cui is not null then 'high' else 'normal' end importance from m1 left join hi on hi.cui=m1.cui)
select pair_id, importance, phrase as "text", cui from m2""")
def q_rank(spark, d):
    m = terms.mentions(part_pairs(spark, d), "original", part_synonyms(spark, d), keys=("pair_id",))
    r = m.select("pair_id", F.inline(terms.rank_concepts(F.col("original"), F.col("_mentions"))))
    return r.select("pair_id", "importance", "text", "cui")


CRIT = K.norm_set("original", rules.CRITICAL_PATTERNS, K.strip)


@query("format_concepts", f"""with {REPORTS_SQL}, c as (select pair_id, unnest({CRIT}) x from reports),
u as (select pair_id, min(x) x from c group by pair_id, lower(x)), t as (select * from u qualify row_number() over (partition by pair_id order by x)<=15)
select pair_id, 'Concepts to keep:'||chr(10)||string_agg('  * '||x||' [MUST INCLUDE]', chr(10) order by x) as block from t group by 1""")
def q_format(spark, d):
    none = F.expr("cast(array() as array<struct<pos:int,phrase:string,cui:string,tuis:array<string>>>)")
    r = reports(spark, d).withColumn("ranked", terms.rank_concepts(F.col("original"), none))
    return r.select("pair_id", terms.format_concepts(F.col("ranked")).alias("block"))


# Risk terms of the rewrite whose concept the original does not mention. Terms with the same first letter
# share a concept, and terms of a length divisible by three are of a type that is no risk.
@query("grounding_concepts", f"""with {REPORTS_SQL}, s as (select distinct pair_id, x from (select pair_id, unnest({GROUNDING_SQL.replace('lower(t)', 'lower(simplified)')}) x from reports) where {RISK}),
o as (select distinct pair_id, x from (select pair_id, unnest({GROUNDING_SQL.replace('lower(t)', 'lower(original)')}) x from reports) where {RISK})
select pair_id, 'umls_grounding_validator' validator, 'UMLS_HIGH_RISK_TERM' code, 'CRITICAL' severity, x term, md5(x[1]) cui from s
where length(x)%3<>0 and not exists (select 1 from o where o.pair_id=s.pair_id and o.x[1]=s.x[1])""")
def q_grounding_concepts(spark, d):
    from ..functions import extract as E
    r = reports(spark, d)
    seen = r.select(F.explode(F.array(F.col("original"), F.col("simplified"))).alias("t")).select(
        F.explode(E.text_risk_terms(F.col("t"))).alias("term")).distinct()
    kind = F.when(F.length("term") % 3 == 0, "T079").otherwise("T191")
    table_ = seen.select("term", F.md5(F.left("term", F.lit(1))).alias("cui"), F.array(kind).alias("semantic_types"), F.lit(5.0).alias("score"))
    return validate.grounding_concepts(r, table_).select(
        "pair_id", "validator", "code", "severity", F.col("summary_span").alias("term"), F.col("metadata")["cui"].alias("cui"))


# --------------------------------------------------------------- delimited rows
_LINE = "cast(p_partkey as string)||'|'||p_name||'|'||case when p_size%3=0 then '' else p_type end||'|'||case when p_size%4=0 then '' else p_brand end||'|||'"


@query("parse_rrf", f"""with l as (select p_partkey ord, regexp_replace({_LINE}, '\\|+$', '') v from part), p as (select ord, string_split(v, '|') a from l)
select ord, a[1] "A", coalesce(a[2], '') "B", coalesce(a[3], '') "C", coalesce(a[4], '') "D", coalesce(a[5], '') "E" from p""")
def q_parse_rrf(spark, d):
    from ..sources.readers import parse_rrf
    lines = spread(table(spark, d, "part")).select(F.expr(_LINE).alias("value"), F.col("p_partkey").alias("ord"))
    return parse_rrf(lines, ["A", "B", "C", "D", "E"])

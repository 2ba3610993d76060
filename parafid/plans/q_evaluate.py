"""Queries: evaluators, dataset aggregation, operations metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rx import once
from ..functions.readability import readability, simple_readability
from ..operators import evaluate, terms, validate
from . import sqlkit as K
from .checkpoints import cut
from .fixtures import (CONSO_SQL, DIALOGUE_SQL, NOTES_SQL, REPORTS_SQL, RUNS_SQL, STY_SQL, SYN_SQL, dialogue, mrconso, mrsty,
                       notes, reports, runs, spread, table)
from .q_extract import KEYS_SQL, jargon_sql
from .q_validate import SCORED, feature_sql, scored
from .registry import query


# ---------------------------------------------------------------- readability
def read_sql(src: str, keys: str, t: str = "t") -> str:
    """CTE ``rd``: fkgl, smog, asl, jargon, tokens, terms of ``t`` (full variant)."""
    med = "+".join(f"len({K.find_all(f'lower({t})', p, 'i')})" for p in rules.MEDICAL_TERM_PATTERNS)
    return f"""rd0 as (select {keys}, {t} t, regexp_extract_all({t}, '[a-zA-Z]+(?:''[a-zA-Z]+)?') w, len({K.terminator_sentences(t)}) ns, {med} nt from {src}),
rd1 as (select {keys}, ns, nt, len(w) nw, list_transform(w, lambda x: {K.syllables('x', True)}) sy from rd0),
rd2 as (select {keys}, ns, nt, nw, coalesce(list_sum(sy), 0) syl, len(list_filter(sy, lambda x: x>=3)) hard from rd1),
rd as (select {keys}, round(case when nw>0 and ns>0 then greatest(0.0, 0.39*(nw/ns)+11.8*(syl/nw)-15.59) else 0.0 end, 2) fkgl,
 round(case when ns>0 then 1.043*sqrt(hard*(case when ns<30 then 30/ns else 1.0 end))+3.1291 else 0.0 end, 2) smog,
 round(coalesce(nw/nullif(ns, 0), 0.0), 2) avg_sentence_length, round(coalesce(nt/nullif(nw, 0), 0.0), 4) jargon_density,
 nw total_tokens, nt cui_count from rd2)"""


@query("readability", f"with {read_sql('documents', 'doc_id', 'text')} select * from rd")
def q_readability(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", readability(F.col("text")).alias("r")).select("doc_id", "r.*")


def simple_sql(src: str, keys: str, cols: dict) -> str:
    """CTEs ``sr_<k>`` per text column: fkgl, smog, asl, jargon, words, sentences (before/after variant)."""
    out = []
    for k, t in cols.items():
        out.append(f"""sr0_{k} as (select {keys}, {K.bounded_words(t)} w, len({K.terminator_sentences(t)}) ns from {src}),
sr1_{k} as (select {keys}, w, ns, len(w) nw, list_transform(w, lambda x: {K.syllables('x', False)}) sy, {jargon_sql('w')} jd from sr0_{k}),
sr2_{k} as (select {keys}, ns, nw, jd, coalesce(list_sum(sy), 0) syl, len(list_filter(sy, lambda x: x>=3)) hard from sr1_{k}),
sr_{k} as (select {keys}, nw, ns, jd, case when nw>0 and ns>0 then round(greatest(0.0, 0.39*(nw/ns)+11.8*(syl/nw)-15.59), 1) else 0.0 end fkgl,
 case when nw>0 and ns>0 then round(case when ns>=3 then 1.043*sqrt(hard*(30/ns))+3.1291 else 3.0+sqrt(hard) end, 1) else 0.0 end smog,
 case when nw>0 and ns>0 then round(nw/ns, 1) else 0.0 end asl from sr2_{k})""")
    return ", ".join(out)


SR = {"o": "original", "s": "simplified"}
COMPARE = """select o.pair_id, o.fkgl original_fkgl, o.smog original_smog, o.asl original_avg_sentence_length, round(o.jd, 4) original_jargon_density,
 s.fkgl simplified_fkgl, s.smog simplified_smog, s.asl simplified_avg_sentence_length, round(s.jd, 4) simplified_jargon_density,
 round(s.fkgl-o.fkgl, 1) fkgl_delta, round(s.smog-o.smog, 1) smog_delta, round(s.asl-o.asl, 1) sentence_length_delta, round(o.jd-s.jd, 4) jargon_reduction
 from sr_o o join sr_s s using (pair_id)"""


@query("readability_compare", f"with {DIALOGUE_SQL}, {simple_sql('dialogue', 'pair_id', SR)} {COMPARE}")
def q_compare(spark, d):
    from ..functions.readability import compare
    p = dialogue(spark, d).select("pair_id", simple_readability(F.col("original")).alias("o"),
                                  simple_readability(F.col("simplified")).alias("s"))
    return p.select("pair_id", compare(F.col("o"), F.col("s")).alias("c")).select("pair_id", "c.*")


# ------------------------------------------------------------ concepts on pairs
def part_synonyms(spark, d):
    """The synonym table, written once as a terminology would be."""
    return cut(terms.build_synonyms(mrconso(spark, d), terms.semantic_types_by_cui(mrsty(spark, d))))


_TERMED = "'Uses '||p_name||' and '||p_type||'.'"


def part_pairs(spark, d):
    """Per order: all part names of its lines (original) and those of lines kept (simplified)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    j = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_TERMED).alias("t")), "l_partkey")
    g = j.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "t"))).alias("l"))
    join = lambda arr: F.array_join(F.transform(arr, lambda z: z["t"]), " ")
    return g.select("pair_id", join(F.col("l")).alias("original"), F.concat(F.lit("We use red widget. "), join(F.filter(
        "l", lambda z: (z["l_linenumber"] + z["l_partkey"]) % 3 != 0))).alias("simplified"))


PART_PAIRS_SQL = f"""pl as (select l_orderkey pair_id, l_linenumber n, l_partkey p, {_TERMED} t from lineitem join part on p_partkey=l_partkey),
pairs as (select pair_id, string_agg(t, ' ' order by n, p, t) original, 'We use red widget. '||coalesce(string_agg(t, ' ' order by n, p, t) filter ((n+p)%3<>0), '') simplified from pl group by 1)"""


def gazetteer_sql(src: str) -> str:
    """CTE ``men(pair_id, side, pos, phrase, cui)``: greedy longest matches by recursion over positions."""
    return f"""{CONSO_SQL}, {SYN_SQL}, one as (select term_lower, arg_min(cui, struct_pack(a := not is_preferred, b := ord, c := cui)) cui from syn group by 1),
{K.sides(src)}, tw as (select pair_id, side, regexp_extract_all(lower(t), {K.rx("[" + chr(92) + "w']+(?:-[" + chr(92) + "w']+)*")}) w from tx),
ng as (select pair_id, side, i, n, array_to_string(w[i:i+n-1], ' ') phrase from (select pair_id, side, w, unnest(range(1, len(w)+1)) i from tw), (values (1),(2),(3),(4)) v(n) where i+n-1<=len(w)),
hit as (select pair_id, side, i, n, phrase, cui from ng join one on term_lower=phrase qualify row_number() over (partition by pair_id, side, i order by n desc)=1),
walk as (with recursive r as (select pair_id, side, min(i) i from hit group by 1,2
 union all select r.pair_id, r.side, (select min(h2.i) from hit h2 where h2.pair_id=r.pair_id and h2.side=r.side and h2.i>=r.i+h.n)
 from r join hit h on h.pair_id=r.pair_id and h.side=r.side and h.i=r.i) select * from r where i is not null),
men as (select w.pair_id, w.side, w.i pos, h.phrase, h.cui from walk w join hit h using (pair_id, side, i))"""


def with_concepts(spark, d, pairs):
    syn = part_synonyms(spark, d)
    a = terms.match_concepts(pairs, "original", syn, keys=("pair_id",), out="orig_concepts")
    return terms.match_concepts(a, "simplified", syn, keys=("pair_id",), out="simp_concepts")


@query("concept_overlap", f"""with {PART_PAIRS_SQL}, {gazetteer_sql('pairs')}, {STY_SQL},
wt as (select CUI cui, max(case when TUI in ({', '.join(K.q(t) for t in rules.WEIGHTED_TYPES)}) then 2.0 else 1.0 end) w from sty group by 1),
cs as (select distinct pair_id, side, cui from men), oc as (select * from cs where side='o'), sc as (select * from cs where side='s'),
g as (select p.pair_id, (select count(*) from oc where oc.pair_id=p.pair_id) no, (select count(*) from sc where sc.pair_id=p.pair_id) ns,
 (select count(*) from oc join sc using (pair_id, cui) where oc.pair_id=p.pair_id) sh,
 (select coalesce(sum(coalesce(w, 1.0)), 0) from oc left join wt using (cui) where oc.pair_id=p.pair_id) wo,
 (select coalesce(sum(coalesce(w, 1.0)), 0) from sc left join wt using (cui) where sc.pair_id=p.pair_id) ws,
 (select coalesce(sum(coalesce(w, 1.0)), 0) from oc join sc using (pair_id, cui) left join wt using (cui) where oc.pair_id=p.pair_id) wh from pairs p),
h as (select *, coalesce(sh/nullif(ns, 0), 0.0) p, coalesce(sh/nullif(no, 0), 0.0) r, coalesce(cast(wh as double)/nullif(ws, 0), 0.0) wp, coalesce(cast(wh as double)/nullif(wo, 0), 0.0) wr from g)
select pair_id, round(p, 4) cui_precision, round(r, 4) cui_recall, round(coalesce(2*p*r/nullif(p+r, 0), 0.0), 4) cui_f1, no original_cui_count, ns simplified_cui_count,
 sh shared_cui_count, nullif(round(coalesce(2*wp*wr/nullif(wp+wr, 0), 0.0), 4), 0.0) semantic_type_weighted_f1 from h""")
def q_overlap(spark, d):
    p = with_concepts(spark, d, part_pairs(spark, d))
    c = p.select("pair_id", evaluate.concept_overlap(F.col("orig_concepts"), F.col("simp_concepts")).alias("c"))
    return c.select("pair_id", "c.*")


@query("match_concepts", f"with {PART_PAIRS_SQL}, {gazetteer_sql('pairs')} select pair_id, pos, phrase, cui from men where side='o'")
def q_match_concepts(spark, d):
    m = terms.mention_table(part_pairs(spark, d), "original", part_synonyms(spark, d), keys=("pair_id",))
    return m.select("pair_id", F.inline(once(F.col("_mentions")))).select("pair_id", "pos", "phrase", "cui")


@query("coverage", f"""with {PART_PAIRS_SQL}, {gazetteer_sql('pairs')}, cs as (select distinct pair_id, side, cui from men)
select p.pair_id, round(coalesce(count(s.cui)/nullif(count(o.cui), 0), 1.0), 4) source_cui_recall, count(o.cui) total_source_cuis, count(s.cui) covered_source_cuis
 from pairs p left join (select * from cs where side='o') o using (pair_id) left join (select * from cs where side='s') s on s.pair_id=o.pair_id and s.cui=o.cui group by 1""")
def q_coverage(spark, d):
    p = with_concepts(spark, d, part_pairs(spark, d))
    e = evaluate.evaluate_samples(p, ("coverage",), keys=("pair_id",), concepts=True)
    return e.select("pair_id", "coverage.source_cui_recall", "coverage.total_source_cuis", "coverage.covered_source_cuis")


_CK = lambda c: KEYS_SQL.replace("lower(t)", f"lower({c})")
COVER = f"cv as (select pair_id, {_CK('original')} a, {_CK('simplified')} b from {{src}}), cw as (select pair_id, len(a) total_measurements, len(list_intersect(a, b)) preserved_measurements from cv)"


@query("coverage_measurements", f"with {NOTES_SQL}, {COVER.replace('{src}', 'notes')} select *, round(coalesce(preserved_measurements/nullif(total_measurements, 0), 1.0), 4) key_measurements_present from cw")
def q_coverage_measurements(spark, d):
    e = evaluate.evaluate_samples(notes(spark, d), ("coverage",), keys=("pair_id",))
    return e.select("pair_id", "coverage.total_measurements", "coverage.preserved_measurements", "coverage.key_measurements_present")


# --------------------------------------------------------------------- quality
def quality_sql(src: str) -> str:
    groups = (("dx", rules.DIAGNOSIS_PATTERNS), ("rx", rules.MEDICATION_PATTERNS), ("ms", rules.MEASUREMENT_PATTERNS))
    cols = ", ".join(f"{K.norm_set(c, p, K.lower_collapse)} {g}_{s}" for g, p in groups for s, c in SR.items())
    miss = ", ".join(f"len({g}_o) {g}_n, list_sort({K.fuzzy_missing(g + '_o', g + '_s')}) {g}_m" for g, _ in groups)
    return f"""{simple_sql(src, 'pair_id', SR)}, qa as (select pair_id, {cols} from {src}), qb as (select pair_id, {miss} from qa),
qc as (select qb.*, dx_n+rx_n+ms_n n, len(dx_m)+len(rx_m)+len(ms_m) lost, o.nw ow, s.nw sw, o.fkgl-s.fkgl gain from qb join sr_o o using (pair_id) join sr_s s using (pair_id)),
qd as (select *, coalesce((n-lost)/nullif(n, 0), 1.0) crit, coalesce((ms_n-len(ms_m))/nullif(ms_n, 0), 1.0) meas, case when sw>0 and gain>0 then least(0.2, gain/10) else 0.0 end bonus from qc),
qual as (select pair_id, 1.0 concept_recall, round(crit, 4) critical_concept_recall, round(meas, 4) measurement_preservation, round(cast(ow as double), 2) original_words_per_concept,
 round(cast(sw as double), 2) simplified_words_per_concept, round(coalesce(sw/nullif(ow, 0), 1.0), 2) expansion_ratio, dx_m missing_diagnoses, rx_m missing_medications, ms_m missing_measurements,
 round(0.4*crit+0.3*1.0+0.1*meas+0.2*bonus, 4) simplification_score from qd)"""


@query("simplification_quality", f"with {REPORTS_SQL}, {quality_sql('reports')} select * exclude (missing_diagnoses, missing_medications, missing_measurements),"
       " array_to_string(missing_diagnoses, '|') missing_diagnoses, array_to_string(missing_medications, '|') missing_medications, array_to_string(missing_measurements, '|') missing_measurements from qual")
def q_quality(spark, d):
    e = evaluate.evaluate_samples(reports(spark, d), ("simplification",), keys=("pair_id",)).select("pair_id", "simplification_quality.*")
    return e.withColumns({c: F.array_join(c, "|") for c in e.columns if c.startswith("missing_")})


# ------------------------------------------------------------------------- nli
NLI = """select pair_id, round(avg(case when "label"='entailment' then 1 else 0 end), 4) entailment_rate, round(avg(case when "label"='neutral' then 1 else 0 end), 4) neutral_rate,
 round(avg(case when "label"='contradiction' then 1 else 0 end), 4) contradiction_rate, count(*) total_pairs,
 round(coalesce(avg(conf) filter ("label"='entailment'), 0.0), 4) avg_entailment_confidence, round(coalesce(avg(conf) filter ("label"='contradiction'), 0.0), 4) avg_contradiction_confidence from scored group by 1"""


@query("nli_distribution", f"with {NOTES_SQL}, {feature_sql('notes')}, {SCORED} {NLI}")
def q_nli(spark, d):
    return evaluate.nli_distribution(scored(notes(spark, d)))


# --------------------------------------------------------------- dataset level
_GROUP = "case pair_id%3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end"
DATASET = f"""{{src}}, {{parts}}
select {_GROUP} dataset, 'v1' model_version, count(*) sample_count, round(avg(r.fkgl), 2) readability_fkgl, round(avg(r.smog), 2) readability_smog,
 round(avg(r.avg_sentence_length), 2) readability_avg_sentence_length, round(avg(r.jargon_density), 4) readability_jargon_density, sum(r.total_tokens) readability_total_tokens, sum(r.cui_count) readability_cui_count,
 round(avg(q.critical_concept_recall), 4) quality_critical_concept_recall, round(avg(q.measurement_preservation), 4) quality_measurement_preservation, round(avg(q.simplification_score), 4) quality_simplification_score,
 round(avg(coalesce(preserved_measurements/nullif(total_measurements, 0), 1.0)), 4) coverage_key_measurements_present, sum(total_measurements) coverage_total_measurements, sum(preserved_measurements) coverage_preserved_measurements,
 round(coalesce(sum(preserved_measurements)/nullif(sum(total_measurements), 0), 1.0), 4) coverage_micro_measurement_rate
 from rd r join qual q using (pair_id) join cw using (pair_id) group by 1"""
DATASET_COLS = ["dataset", "model_version", "sample_count", "readability_fkgl", "readability_smog", "readability_avg_sentence_length",
                "readability_jargon_density", "readability_total_tokens", "readability_cui_count", "quality_critical_concept_recall",
                "quality_measurement_preservation", "quality_simplification_score", "coverage_key_measurements_present",
                "coverage_total_measurements", "coverage_preserved_measurements", "coverage_micro_measurement_rate"]


def tagged(df):
    return df.withColumns({"dataset": F.expr(_GROUP), "model_version": F.lit("v1")})


def evaluated(df):
    return evaluate.evaluate_samples(tagged(df), ("readability", "simplification", "coverage"), keys=("pair_id",))


@query("aggregate_dataset", "with " + DATASET.format(src=NOTES_SQL, parts=", ".join([
    read_sql("notes", "pair_id", "simplified"), quality_sql("notes"), COVER.replace('{src}', 'notes')])))
def q_dataset(spark, d):
    return evaluate.aggregate_dataset(evaluated(notes(spark, d))).select(*DATASET_COLS)


OPS_SQL = f"""oa as (select {_GROUP} dataset, {{ms}} v from notes), ob as (select *, row_number() over (partition by dataset order by v) r, count(*) over (partition by dataset) n from oa)
select dataset, count(*) ops_runs, max(v) filter (r=n//2+1) ops_latency_p50_ms, max(v) filter (r=least(cast(floor(n*0.95) as bigint)+1, n)) ops_latency_p95_ms, round(avg(v), 2) ops_latency_mean_ms from ob group by 1"""


@query("aggregate_ops", f"with {NOTES_SQL}, {OPS_SQL.replace('{ms}', 'cast(len(original) as double)')}")
def q_dataset_ops(spark, d):
    """Run metrics attached to the dataset-level row of their group; the length of the text stands for the latency."""
    n = tagged(notes(spark, d))
    runs_ = evaluate.record_runs(n, F.length("original").cast("double"), group=("dataset", "model_version"))
    a = evaluate.aggregate_dataset(n, runs=runs_)
    return a.select("dataset", "ops_runs", "ops_latency_p50_ms", "ops_latency_p95_ms", "ops_latency_mean_ms")


@query("aggregate_semantic", f"with {NOTES_SQL} select {_GROUP} dataset, round(avg((pair_id%10)/10.0), 4) semantic_precision, round(avg((pair_id%7)/7.0), 4) semantic_recall, round(avg((pair_id%5)/5.0), 4) semantic_f1 from notes group by 1")
def q_dataset_semantic(spark, d):
    """Means of a caller's similarity table."""
    n = notes(spark, d)
    table_ = n.select("pair_id", *[((F.col("pair_id") % k) / float(k)).alias(c) for c, k in (("precision", 10), ("recall", 7), ("f1", 5))])
    e = evaluate.evaluate_samples(tagged(n), ("semantic",), keys=("pair_id",), semantic=table_)
    return evaluate.aggregate_dataset(e).select("dataset", "semantic_precision", "semantic_recall", "semantic_f1")


@query("aggregate_missing", f"""with {REPORTS_SQL}, {quality_sql('reports')}, it as (select distinct {_GROUP} dataset, unnest(missing_measurements) item from qual)
select dataset, string_agg(item, '|' order by item) missing_measurements from (select * from it qualify row_number() over (partition by dataset order by item)<=10) group by 1""")
def q_missing(spark, d):
    e = evaluate.evaluate_samples(tagged(reports(spark, d)), ("simplification",), keys=("pair_id",))
    a = evaluate.aggregate_dataset(e, missing=True)
    return a.select("dataset", F.array_join("missing_measurements", "|").alias("missing_measurements"))


@query("aggregate_nli", f"""with {NOTES_SQL}, {feature_sql('notes')}, {SCORED}, nl as ({NLI})
select {_GROUP} dataset, sum(total_pairs) nli_total_pairs, round(sum(contradiction_rate*total_pairs)/sum(total_pairs), 4) nli_contradiction_rate,
 round(avg(avg_entailment_confidence), 4) nli_avg_entailment_confidence from nl group by 1""")
def q_dataset_nli(spark, d):
    n = notes(spark, d)
    table_ = evaluate.nli_distribution(scored(n))
    e = evaluate.evaluate_samples(tagged(n), ("nli",), keys=("pair_id",), nli=table_)
    a = evaluate.aggregate_dataset(e)
    return a.select("dataset", "nli_total_pairs", "nli_contradiction_rate", "nli_avg_entailment_confidence")


@query("evaluate_samples", f"with {REPORTS_SQL}, {read_sql('reports', 'pair_id', 'simplified')}, {quality_sql('reports')}, {COVER.replace('{src}', 'reports')}"
       " select pair_id, r.fkgl, r.smog, r.total_tokens, q.simplification_score, total_measurements from rd r join qual q using (pair_id) join cw using (pair_id)")
def q_evaluate(spark, d):
    e = evaluate.evaluate_samples(reports(spark, d), ("readability", "simplification", "coverage"), keys=("pair_id",))
    return e.select("pair_id", "readability.fkgl", "readability.smog", "readability.total_tokens",
                    "simplification_quality.simplification_score", "coverage.total_measurements")


@query("baseline_eval", f"with {DIALOGUE_SQL}, {read_sql('dialogue', 'pair_id', 'simplified')} select pair_id, fkgl, smog, avg_sentence_length, total_tokens from rd")
def q_baseline(spark, d):
    p = dialogue(spark, d).withColumnRenamed("simplified", "reference")
    e = evaluate.baseline_eval(p, ("readability",), keys=("pair_id",))
    return e.select("pair_id", "readability.fkgl", "readability.smog", "readability.avg_sentence_length", "readability.total_tokens")


# -------------------------------------------------------------------------- ops
OPS = """with {src}, rk as (select *, row_number() over (partition by event_type order by latency_ms) r, count(*) over (partition by event_type) n from {name})
select event_type, count(*) runs, round(max(latency_ms) filter (r=least(n//2+1, n)), 2) latency_p50_ms, round(max(latency_ms) filter (r=least(cast(floor(n*0.95) as bigint)+1, n)), 2) latency_p95_ms,
 round(avg(latency_ms), 2) latency_mean_ms, round(avg(input_tokens+output_tokens), 2) cost_per_report_tokens, round(avg(case when retry_count>0 then 1 else 0 end), 4) retry_rate,
 round(avg(case when refinement_count>0 then 1 else 0 end), 4) refinement_rate, round(avg(case when first_pass_success then 1 else 0 end), 4) first_pass_success_rate from rk group by 1"""


@query("ops_metrics", OPS.format(src=RUNS_SQL, name="runs"))
def q_ops(spark, d):
    return evaluate.ops_metrics(runs(spark, d), ("event_type",))


@query("ops_metrics_total", OPS.format(src=RUNS_SQL + ", one as (select 'all' event_type, * exclude (event_type) from runs)", name="one").replace("select event_type, count(*)", "select count(*)").replace("group by 1", "group by event_type"))
def q_ops_total(spark, d):
    return evaluate.ops_metrics(runs(spark, d))


@query("record_runs", "select event_type, count(*) runs, sum(input_tokens) tokens_in, sum(retry) retries from (select event_type, cast(event_id%7 as int) input_tokens, 0 retry from events) group by 1")
def q_record(spark, d):
    e = table(spark, d, "events").withColumn("tin", (F.col("event_id") % 7).cast("int"))
    r = evaluate.record_runs(e, F.col("value"), group=("event_type",), input_tokens="tin")
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("tokens_in"), F.sum("retry_count").alias("retries"))


# ------------------------------------------------------------------------ stats
STATS = f"""st as (select p.pair_id, len(p.original) original_chars, len({K.words_ws('p.original')}) original_words, len(p.simplified) simplified_chars, len({K.words_ws('p.simplified')}) simplified_words,
 o.fkgl original_fkgl, s.fkgl simplified_fkgl, round(s.fkgl-o.fkgl, 1) fkgl_delta, round(s.smog-o.smog, 1) smog_delta, round(o.jd-s.jd, 4) jargon_reduction from {{src}} p join sr_o o using (pair_id) join sr_s s using (pair_id)),
st2 as (select *, round(simplified_words/greatest(1, original_words), 4) expansion_ratio from st)"""
STAT_COLS = ["original_chars", "original_words", "simplified_chars", "simplified_words", "original_fkgl", "simplified_fkgl", "fkgl_delta",
             "smog_delta", "jargon_reduction", "expansion_ratio"]


@query("sample_stats", f"with {DIALOGUE_SQL}, {simple_sql('dialogue', 'pair_id', SR)}, {STATS.replace('{src}', 'dialogue')} select pair_id, {', '.join(STAT_COLS)} from st2")
def q_sample_stats(spark, d):
    return evaluate.sample_stats(dialogue(spark, d), ("pair_id",)).select("pair_id", *STAT_COLS)


_ERR = "case when original_words%11=0 then 'timeout' else '' end"


def stat_rows(spark, d):
    s = evaluate.sample_stats(dialogue(spark, d), ("pair_id",))
    return s.withColumns({"error": F.expr(_ERR), "latency_ms": F.col("original_chars").cast("double"),
                          "simplification_score": F.greatest(F.lit(0.0), 1.0 - F.col("expansion_ratio")),
                          "validation_iterations": (F.col("original_words") % 4), "first_pass_success": F.col("original_words") % 2 == 0,
                          "needs_review": F.col("original_words") % 5 == 0})


ST3 = f"st3 as (select *, {_ERR} err, cast(original_chars as double) latency_ms, greatest(0.0, 1.0-expansion_ratio) sc from st2)"


@query("stats_summary", f"with {DIALOGUE_SQL}, {simple_sql('dialogue', 'pair_id', SR)}, {STATS.replace('{src}', 'dialogue')}, {ST3}, g as (select * from st3 where err='')"
       " select (select count(*) from st3) total, count(*) successful, (select count(*) from st3 where err<>'') failed, min(fkgl_delta) fkgl_delta_min, max(fkgl_delta) fkgl_delta_max, round(avg(fkgl_delta), 4) fkgl_delta_avg,"
       " min(latency_ms) latency_ms_min, max(latency_ms) latency_ms_max, round(avg(latency_ms), 4) latency_ms_avg, min(sc) filter (sc>0) simplification_score_min, max(sc) filter (sc>0) simplification_score_max, round(avg(sc) filter (sc>0), 4) simplification_score_avg,"
       " round(avg(case when original_words%2=0 then 1 else 0 end), 4) first_pass_success_share, round(avg(case when original_words%5=0 then 1 else 0 end), 4) needs_review_share from g")
def q_stats_summary(spark, d):
    return evaluate.stats_summary(stat_rows(spark, d))


@query("ops_from_stats", f"with {DIALOGUE_SQL}, {simple_sql('dialogue', 'pair_id', SR)}, {STATS.replace('{src}', 'dialogue')}, {ST3}"
       " select count(*) runs, sum(latency_ms) latency, sum(original_words+simplified_words) tokens, sum(greatest(0, original_words%4-1)) retries from st3 where err=''")
def q_ops_from_stats(spark, d):
    r = evaluate.ops_from_stats(stat_rows(spark, d))
    return r.agg(F.count(F.lit(1)).alias("runs"), F.sum("latency_ms").alias("latency"),
                 F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("retry_count").alias("retries"))


@query("chunk_iterations", "select conv_id, count(*) chunk_count, sum(1+turn%3)//count(*) validation_iterations, bool_or(role='tool' or turn%5=4) needs_review, not bool_or(role='tool' or turn%5=4) first_pass_success from conversations group by 1")
def q_chunk_iterations(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (1 + F.col("turn") % 3).alias("iteration"),
                                                ((F.col("role") == "tool") | (F.col("turn") % 5 == 4)).alias("needs_review"))
    return evaluate.chunk_iterations(c, ("conv_id",))


@query("dataset_stats", f"""with t as (select doc_id, source, lang, {K.strip('text')}='' bo, length(text)%97=0 bt from documents),
u as (select 'source' dim, coalesce(source, 'unknown') "value", * from t union all select 'lang', coalesce(lang, 'unknown'), * from t union all select 'total', 'all', * from t)
select dim, "value", count(*) "rows", round(count(*)/(select count(*) from t), 4) share, count(*) filter (bo) blank_originals, count(*) filter (bt) blank_targets,
 count(*)-greatest(count(*) filter (bo), count(*) filter (bt)) valid_approx, count(*)-count(*) filter (bo or bt) valid_exact from u group by 1,2""")
def q_dataset_stats(spark, d):
    t = table(spark, d, "documents").withColumn("target", F.when(F.length("text") % 97 == 0, " ").otherwise("x"))
    return evaluate.dataset_stats(t, "text", "target", ("source", "lang"))


@query("log_metrics_long", "with agg as (" + "with " + DATASET.format(src=NOTES_SQL, parts=", ".join([
    read_sql("notes", "pair_id", "simplified"), quality_sql("notes"), COVER.replace('{src}', 'notes')])) + """) select dataset, model_version, metric, cast("value" as double) "value" from (
 select dataset, model_version, 'readability/fkgl' metric, readability_fkgl "value" from agg union all select dataset, model_version, 'readability/smog', readability_smog from agg
 union all select dataset, model_version, 'coverage/total_measurements', coverage_total_measurements from agg)""")
def q_metrics_long(spark, d):
    a = evaluate.aggregate_dataset(evaluated(notes(spark, d)))
    return evaluate.log_metrics_long(a, {"readability": ["fkgl", "smog"], "coverage": ["total_measurements"]})


@query("runs_from_events", """with e as (select user_id, ts, event_type, value,
 case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as run from e),
r as (select user_id, run, min(ts) filter (event_type='signup') as started, max(ts) filter (event_type='purchase') as finished,
 coalesce(sum(floor(value)) filter (event_type='view'), 0)::bigint as input_tokens, coalesce(sum(floor(value)) filter (event_type='click'), 0)::bigint as output_tokens,
 count(*) filter (event_type='error') as retry_count from s group by 1, 2)
select user_id, started, finished, case when started is null then 'no_start' when finished>=started then 'finished' else 'open' end as status,
 case when finished>=started then (epoch_us(finished)-epoch_us(started))/1000.0 end::double as latency_ms, input_tokens, output_tokens, retry_count,
 0::bigint as refinement_count, retry_count=0 as first_pass_success from r""")
def q_runs_from_events(spark, d):
    """A user's signup starts a run, a purchase ends it, views and clicks are tokens, errors retries."""
    from ..streaming.runs import runs_from_events
    kind = F.col("event_type")
    name = F.when(kind == "view", "input_tokens").when(kind == "click", "output_tokens").when(kind == "error", "retry_count")
    e = table(spark, d, "events").select(
        "user_id", "ts", F.when(kind == "signup", "start").when(kind == "purchase", "finish").otherwise("counter").alias("kind"),
        name.alias("name"), F.when(kind == "error", 1.0).otherwise(F.floor("value")).alias("value"))
    return runs_from_events(e, key="user_id", timeout="6 hours")


@query("ops_windowed", "select date_trunc('hour', ts) window_start, event_type, count(*) runs, round(avg(value), 2) latency_mean_ms, round(avg(case when event_type<>'error' then 1 else 0 end), 4) first_pass_success_rate from events group by 1,2")
def q_ops_windowed(spark, d):
    from ..streaming.ops import ops_windowed
    r = table(spark, d, "events").select("ts", "event_type", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("first_pass_success"))
    return ops_windowed(r).select("window_start", "event_type", "runs", "latency_mean_ms", "first_pass_success_rate")

"""Queries: report, glossary and citation assembly; table-shaped sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rx import once
from ..operators import match, report
from ..sources import readers, writers
from . import sqlkit as K
from .fixtures import DIALOGUE_SQL, REPORTS_SQL, dialogue, reports, spread, table
from .process import process_reports
from .registry import query


def turns(spark, d):
    """Conversation turns as chunks of one report per conversation."""
    c = table(spark, d, "conversations")
    title = lambda n: F.concat(F.lit("Title "), (F.col("turn") % n).cast("string"))
    return c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("original_chunk"),
        F.concat(F.lit("S: "), F.col("text")).alias("simplified_chunk"), (F.col("turn") % 5 == 4).alias("needs_review"),
        F.map_from_arrays(F.array(title(3), F.lit("Shared")), F.array(
            F.array(F.concat(F.lit("a"), F.col("turn").cast("string"))),
            F.array(F.concat(F.lit("b"), F.col("turn").cast("string")), F.lit("c")))).alias("citations"))


@query("assemble_report", "select conv_id doc_id, string_agg('S: '||text, chr(10)||chr(10) order by turn) simplified_text, string_agg(text, chr(10)||chr(10) order by turn) original_text,"
       " bool_or(turn%5=4) needs_review, count(*) chunks, case when len(string_agg('S: '||text, chr(10)||chr(10) order by turn))>500 then left(string_agg('S: '||text, chr(10)||chr(10) order by turn), 500)||'...'"
       " else string_agg('S: '||text, chr(10)||chr(10) order by turn) end summary_text from conversations group by 1")
def q_assemble(spark, d):
    return report.assemble_report(turns(spark, d))


CITE = """ct as (select conv_id doc_id, turn, 0 p, 'Title '||(turn%3) title, 'a'||turn seg from conversations union all select conv_id, turn, 1, 'Shared', 'b'||turn||',c' from conversations),
mc as (select doc_id, title, string_agg(seg, ',' order by turn, p) segments, min(turn*10+p) f from ct group by 1,2), nc as (select *, row_number() over (partition by doc_id order by f, title) number from mc)"""


@query("merge_citations", f"with {CITE} select doc_id, title, segments from mc")
def q_merge(spark, d):
    return report.merge_citations(turns(spark, d)).select("doc_id", "title", F.array_join("segments", ",").alias("segments"))


@query("citation_map", f"with {CITE} select doc_id, string_agg(title||'='||segments, ';' order by f, title) citations from mc group by 1")
def q_map(spark, d):
    m = report.citation_map(report.merge_citations(turns(spark, d)))
    return m.select("doc_id", F.array_join(F.transform(F.map_entries("citations"), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("citations"))


@query("number_citations", f"with {CITE} select doc_id, title, number from nc")
def q_number(spark, d):
    return report.number_citations(report.merge_citations(turns(spark, d))).select("doc_id", "title", "number")


@query("cited_sources", f"""with {CITE}, s as (select conv_id doc_id, 'Title '||(turn%4) title, turn ord, 'http://x/'||turn url, text summary from conversations),
f as (select * from s qualify row_number() over (partition by doc_id, title order by ord)=1) select doc_id, title, number citation_number, url, summary from nc join f using (doc_id, title)""")
def q_cited(spark, d):
    n = report.number_citations(report.merge_citations(turns(spark, d)))
    s = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("Title "), (F.col("turn") % 4).cast("string")).alias("title"),
        F.col("turn").alias("ord"), F.concat(F.lit("http://x/"), F.col("turn").cast("string")).alias("url"), F.col("text").alias("summary"))
    return match.cited_sources(n, s)


def sources_json(spark, d):
    """Per page a JSON list of sources; some fields are missing."""
    p = table(spark, d, "pages").select("page_id", "url")
    one = F.to_json(F.struct(F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).alias("title"),
                             F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"), F.col("url").alias("link"),
                             F.when(F.col("page_id") % 4 != 0, F.repeat(F.lit("s"), 310)).alias("summary"),
                             F.when(F.col("page_id") % 5 != 0, F.array(*[F.lit(x) for x in "wxyz"])).alias("highlights")))
    return p.select("page_id", "url", F.when(F.col("page_id") % 7 == 0, "[]").otherwise(
        F.concat(F.lit("["), one, F.lit("]"))).alias("sources"))


@query("project_sources", "select page_id, case when page_id%3<>0 then 'T'||page_id else 'Untitled' end title, url, case when page_id%4<>0 then repeat('s', 310) else 'No summary available' end summary from pages where page_id%7<>0")
def q_project(spark, d):
    return sources_json(spark, d).select("page_id", F.inline(report.project_sources(F.col("sources"))))


@query("format_sources", "select page_id, case when page_id%7=0 then 'No sources available.' else '- **'||case when page_id%3<>0 then 'T'||page_id else 'Untitled' end||'**'||chr(10)||'  Summary: '||"
       "case when page_id%4<>0 then repeat('s', 300) else 'No summary' end||chr(10)||'  Key excerpts: '||case when page_id%5<>0 then 'w | x | y' else 'No highlights' end end as block from pages")
def q_format(spark, d):
    return sources_json(spark, d).select("page_id", report.format_sources(F.col("sources")).alias("block"))


# ------------------------------------------------------------------- glossary
_CAND = lambda c: f"list_concat(list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}')), {K.find_all(c, rules.GLOSSARY_DOSE, 'i', 1)})"
_DEFN = "case when length(w)%3=0 then 'Means '||w end"
_CATG = "case when length(w)%4=0 then 'anatomy' when length(w)%4=1 then 'other' end"
GLOSS = f"""gw as (select distinct w from (select unnest(string_split(lower(text), ' ')) w from benchmark)),
gd as (select w term, {_DEFN} definition, {_CATG} category from gw),
gt as (select pair_id, list_sort(list_distinct(list_concat({_CAND('original')}, {_CAND('simplified')})))[1:30] a from dialogue),
gl as (select pair_id, i-1 pos, a[i] term from (select pair_id, a, unnest(range(1, len(a)+1)) i from gt)),
gg as (select pair_id, pos, gl.term, case when gd.term is null then 'Medical term related to patient care.' else coalesce(definition, 'Definition not available') end definition, coalesce(category, 'other') category from gl left join gd using (term))"""


def definitions(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    return w.select(F.col("w").alias("term"), F.expr(_DEFN).alias("definition"), F.expr(_CATG).alias("category"))


@query("build_glossary", f"with {DIALOGUE_SQL}, {GLOSS} select * from gg")
def q_glossary(spark, d):
    return report.build_glossary(dialogue(spark, d), definitions(spark, d), ("pair_id",))


def common_words(spark, d):
    """Everyday words of the corpus: those occurring in at least a tenth of the passages."""
    b = table(spark, d, "benchmark")
    w = b.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= 0.1 * b.agg(F.count(F.lit(1))).scalar()).select("word")


@query("filter_glossary", f"""with {DIALOGUE_SQL}, {GLOSS}, cw as (select word from (select item_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}]+'))) word from benchmark) group by 1 having count(*)>=0.1*(select count(*) from benchmark))
select * from gg where len(lower(term))>=3 and lower(term) not in (select word from cw) and not regexp_matches(lower(term), '^[0-9]+$') and not regexp_matches(lower(term), '^(mg|ml|mcg|units?)$')
 and (category in ('diagnosis','test','treatment','anatomy') or regexp_matches(lower(term), '{'|'.join(rules.GLOSSARY_AFFIXES)}') or regexp_matches(term, '^[A-Z]{{2,5}}$') or len(term)>8 or len(regexp_extract_all(lower(term), '[aeiouy]+'))>=3)""")
def q_filter(spark, d):
    g = report.build_glossary(dialogue(spark, d), definitions(spark, d), ("pair_id",))
    return report.filter_glossary(g, common_words(spark, d))


@query("search_glossary", f"with {DIALOGUE_SQL}, {GLOSS} select * from gg where contains(lower(term), 'en') or contains(lower(definition), 'en') or contains(lower(category), 'en')")
def q_search(spark, d):
    return report.search_glossary(report.build_glossary(dialogue(spark, d), definitions(spark, d), ("pair_id",)), "EN")


# ----------------------------------------------------------- inline citations
_CTXT = "'See [title '||(p_size%3)||'] and [Title '||(p_size%3)||' Long] or [TITLE '||((p_size+1)%3)||'] for '||p_name"


def cited_text(spark, d):
    t = table(spark, d, "part").withColumn("t", F.expr(_CTXT))
    k = F.concat(F.lit("Title "), (F.col("p_size") % 3).cast("string"))
    return t.select("p_partkey", "t", F.array(F.struct(k.alias("title"), F.lit(1).alias("number")),
                                              F.struct(F.concat(k, F.lit(" Long")).alias("title"), F.lit(2).alias("number")),
                                              F.struct(F.lit("Absent").alias("title"), F.lit(3).alias("number"))).alias("c"))


@query("link_inline_citations", """select p_partkey, 'See %%CITE_START_1_Title '||k||'%%[title '||k||']%%CITE_END%% and %%CITE_START_2_Title '||k||' Long%%[Title '||k||' Long]%%CITE_END%% or [TITLE '||((p_size+1)%3)||'] for '||p_name as linked
 from (select *, p_size%3 k from part)""")
def q_link(spark, d):
    return cited_text(spark, d).select("p_partkey", report.link_inline_citations(F.col("t"), F.col("c")).alias("linked"))


@query("citation_mentions", "select p_partkey, 'Title '||(p_size%3) title, 1 as \"number\", 1 mentions from part union all select p_partkey, 'Title '||(p_size%3)||' Long', 2, 1 from part")
def q_mentions(spark, d):
    return cited_text(spark, d).select("p_partkey", F.inline(report.citation_mentions(F.col("t"), F.col("c"))))


_HT = ["left lung", "lung", "blood pressure", "pressure", "knee", "aspirin"]


def kept_sql() -> str:
    """CTE ``kept(pair_id, term, s, e)``: spans of the terms, longer terms first."""
    parts = " union all ".join(
        f"select pair_id, {K.q(t)} term, string_split_regex(lower(original), {K.q(chr(92) + 'b' + t + chr(92) + 'b')}) g"
        f" from reports where contains(lower(original), {K.q(t)})" for t in _HT)
    return f"""pos as materialized ({parts}),
st as (select pair_id, term, cast(list_sum(list_transform(g[1:i], lambda z: len(z)))+(i-1)*len(term) as int) s from (select pair_id, term, g, unnest(range(1, len(g))) i from pos)),
sp as materialized (select pair_id, term, s, s+len(term) e from st),
kept as materialized (select * from sp a where not exists (select 1 from sp b where b.pair_id=a.pair_id and len(b.term)>len(a.term) and a.s<b.e and a.e>b.s))"""


@query("highlight_spans", f"""with {REPORTS_SQL}, {kept_sql()} select pair_id, s as "start", e as "end", term from kept""")
def q_highlight(spark, d):
    t = F.array(*[F.lit(x) for x in _HT])
    return reports(spark, d).select("pair_id", F.inline(report.highlight_spans(F.col("original"), t)))


@query("highlight_segments", f"""with {REPORTS_SQL}, {kept_sql()},
k as (select pair_id, s, e, coalesce(lag(e) over (partition by pair_id order by s), 0) p, row_number() over (partition by pair_id order by s desc)=1 as last from kept),
g as (select pair_id, p a, s b, false is_term from k union all select pair_id, s, e, true from k
 union all select r.pair_id, coalesce(k.e, 0), len(original), false from reports r left join k on k.pair_id=r.pair_id and k.last)
select pair_id, row_number() over (partition by pair_id order by a, b)-1 as n, substr(original, a+1, b-a) as "text", is_term from g join reports using (pair_id) where b>a""")
def q_segments(spark, d):
    t = F.array(*[F.lit(x) for x in _HT])
    r = reports(spark, d).withColumn("m", report.highlight_spans(F.col("original"), t))
    s = r.select("pair_id", F.posexplode(once(report.highlight_segments(F.col("original"), F.col("m")))).alias("n", "s"))
    return s.select("pair_id", "n", "s.text", "s.is_term")


# ---------------------------------------------------------------- nested ideas
_IDEAS = ("'{\"main_ideas\": [{\"main_idea\": \"A'||p_partkey||'\", \"details\": [{\"detail\": \"'||p_name||'\"}, {\"detail\": \"x\"}]}, {\"main_idea\": \"B\", \"details\": []}]}'")


@query("flatten_main_ideas", "select p_partkey doc_id, 0 idea_no, 'A'||p_partkey main_idea, 0 detail_no, p_name detail from part union all select p_partkey, 0, 'A'||p_partkey, 1, 'x' from part union all select p_partkey, 1, 'B', null, null from part")
def q_ideas(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_IDEAS).alias("j"))
    return report.flatten_main_ideas(t.withColumn("report", readers.parse_model_json(F.col("j"), report.IDEAS)))


_SIMPLE = "'{\"simplified_main_ideas\": [{\"original_main_idea\": \"o\", \"simplified_main_idea\": \"S'||p_partkey||'\", \"simplified_details\": [{\"original_detail\": \"p\", \"simplified_detail\": \"'||p_name||'\"}]}]}'"


@query("simplified_content", "select p_partkey, '[{\"main_idea\":\"S'||p_partkey||'\",\"details\":[\"'||p_name||'\"]}]' as content from part")
def q_content(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr(_SIMPLE).alias("j"))
    return t.select("p_partkey", report.simplified_content(readers.parse_model_json(F.col("j"), report.SIMPLE_IDEAS)).alias("content"))


@query("build_prompts", f"with {DIALOGUE_SQL} select pair_id, 'Simplify:'||chr(10)||original||chr(10)||'Previous: '||simplified||'.' as prompt from dialogue")
def q_prompts(spark, d):
    return dialogue(spark, d).select("pair_id", report.build_prompts(
        "Simplify:\n{text}\nPrevious: {old}.", text=F.col("original"), old=F.col("simplified")).alias("prompt"))


@query("assemble_pages", "select conv_id doc_id, string_agg(case when turn%6=5 then '[Page '||turn||' extraction failed: timeout]' else text end, chr(10)||chr(10) order by turn) \"text\", count(*) pages, cast(null as varchar) reject_reason from conversations group by 1")
def q_pages(spark, d):
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"),
                                                F.when(F.col("turn") % 6 != 5, F.col("text")).alias("text"), F.lit("timeout").alias("error"))
    return report.assemble_pages(p)


@query("training_pairs", f"with {DIALOGUE_SQL} select pair_id, {K.q(report.TRAINING_INSTRUCTION)}||chr(10)||chr(10)||'Text:'||chr(10)||original||chr(10)||chr(10)||'Simplified:' input_text, simplified target_text from dialogue")
def q_training(spark, d):
    p = dialogue(spark, d).withColumnsRenamed({"original": "original_text", "simplified": "plain_language_text"})
    return report.training_pairs(p).select("pair_id", "input_text", "target_text")


# ------------------------------------------------------------ model JSON ladder
_LADDER = ("case doc_id%5 when 0 then '{\"k\": '||doc_id||'}' when 1 then '```json'||chr(10)||'{\"k\": '||doc_id||'}'||chr(10)||'```' when 2 then '{\"k\":'||chr(8)||' '||doc_id||'}'"
           " when 3 then '{\"s\": \"a'||chr(10)||'b\", \"k\": '||doc_id||'}' else 'Sure: [{\"k\": '||doc_id||'}] end' end")


@query("parse_model_json", "select doc_id, doc_id k, case when doc_id%5=3 then 'a'||chr(10)||'b' end s from documents")
def q_ladder(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr(_LADDER).alias("j"))
    p = t.select("doc_id", readers.parse_model_json(F.col("j"), "struct<k:bigint,s:string>").alias("p"))
    return p.select("doc_id", "p.k", "p.s")


# ----------------------------------------------------------------- table sources
def pair_table(spark, d):
    """The documents as a paired data set: some texts blank, some fields missing."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("index"), F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("original_text"),
                    F.when(F.col("doc_id") % 11 != 0, F.reverse("text")).alias("plain_language_text"),
                    F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("source_dataset"), F.col("lang").alias("split"))


@query("read_pair_dataset", f"select cast(doc_id as varchar) sample_id, {K.strip('text')} original_text, {K.strip('reverse(text)')} reference_text, case when doc_id%13<>0 then source else '' end source_dataset, lang split from documents"
       f" where doc_id%9<>0 and doc_id%11<>0 and lang='en' and {K.strip('text')}<>'' and {K.strip('reverse(text)')}<>''")
def q_pairs(spark, d):
    return readers.clean_pairs(pair_table(spark, d), split="EN")


@query("read_raw_dataset", f"select cast(doc_id as varchar) sample_id, {K.strip('text')} original_text, 'reports' source_dataset, 'unknown' split from documents where len({K.strip('text')})>=50")
def q_raw(spark, d):
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("Text"))
    return readers.clean_raw(raw).drop("reference_text")


@query("sample_n")
def q_sample(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    return readers.sample_n(s, 100, 42)


@query("sample_n_facts", "select least(count(*), 100) rows, least(count(distinct doc_id), 100) ids, least(count(*), 100) known from documents")
def q_sample_facts(spark, d):
    """A sample has its size, repeats no row, and holds rows of the table only."""
    s = q_sample(spark, d)
    known = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang", F.lit(1).alias("k"))
    return s.join(known, ["sample_id", "lang"], "left").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("sample_id").alias("ids"),
                                                            F.count("k").alias("known"))


@query("truncate_texts", "select doc_id, case when len(text)>500 then left(text, 500)||'...' else text end as original_text from documents")
def q_truncate(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("original_text"))
    return writers.truncate_texts(t)


@query("output_samples", "select conv_id, 'chunk_'||(row_number() over (partition by conv_id order by turn)-1) sample_id, text original_text, coalesce(case when turn%3<>0 then 'S: '||text end, '') simplified_text, cast(null as varchar) reference_text from conversations")
def q_output(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(
        x["text"].alias("original_chunk"), F.when(x["turn"] % 3 != 0, F.concat(F.lit("S: "), x["text"])).alias("simplified_chunk"))).alias("simplified_report"))
    return readers.output_samples(c, ("conv_id",))


HIST = "h as (select conv_id*100+turn id, timestamp '2024-01-01' + to_seconds(conv_id*100+turn) as \"date\", text summary from conversations)"


def history(spark, d):
    c = table(spark, d, "conversations")
    i = F.col("conv_id") * 100 + F.col("turn")
    return c.select(i.alias("id"), F.timestamp_seconds(F.lit(1704067200) + i).alias("date"), F.col("text").alias("summary"))


@query("history_list", f"with {HIST} select id, strftime(\"date\", '%Y-%m-%d %H:%M:%S') shown, summary from h")
def q_history(spark, d):
    return writers.history_list(history(spark, d)).select("id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("shown"), "summary")


@query("history_get", f"with {HIST} select id, summary from h where id=101")
def q_history_get(spark, d):
    return writers.history_get(history(spark, d), 101).select("id", "summary")


@query("history_delete", f"with {HIST} select id, summary from h where id<>101")
def q_history_delete(spark, d):
    return writers.history_delete(history(spark, d), 101).select("id", "summary")


# -------------------------------------------------------- end to end (identity generator)


@query("process_reports")
def q_process(spark, d):
    r = spread(reports(spark, d)).select(F.col("pair_id").alias("doc_id"), F.col("original").alias("text"))
    done = process_reports(r, lambda c: F.col("original"), lambda c: F.col("original"), safety=False)
    return done.reports.select("doc_id", "chunks", "needs_review", F.length("simplified_text").alias("chars"))



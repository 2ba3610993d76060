"""Queries: normalisation and segmentation (whole ``documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import sections, terms
from ..functions.sets import exact_round
from . import sqlkit as K
from .fixtures import REPORTS_SQL, reports, spread, table
from .registry import query

DOCS = "documents"


def _docs(spark, d):
    return spread(table(spark, d, DOCS).select("doc_id", "text"))


@query("clean_text", f"select doc_id, {K.collapse('text')} as cleaned from documents")
def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def _sentences(name, func, sql):
    @query(name, f"select doc_id, i-1 as pos, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s)+1)) i"
                 f" from (select doc_id, {sql('text')} s from documents))")
    def run(spark, d):
        return _docs(spark, d).select("doc_id", F.posexplode(func(F.col("text"))).alias("pos", "sentence"))


_sentences("sentences_lookbehind", T.sentences_lookbehind, K.lookbehind_sentences)
_sentences("sentences_terminator", T.sentences_terminator, K.terminator_sentences)
_sentences("sentences_expanded", T.sentences_expanded, K.expanded_sentences)


def _words(name, func, sql):
    @query(name, f"select doc_id, len(w) as words, len(list_distinct(w)) as distinct_words,"
                 f" md5(array_to_string(w, ' ')) as digest from (select doc_id, {sql} w from documents)")
    def run(spark, d):
        w = _docs(spark, d).select("doc_id", func(F.col("text")).alias("w"))
        return w.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"),
                        F.md5(F.array_join("w", " ")).alias("digest"))


_words("words_apostrophe", T.words_apostrophe, "regexp_extract_all(text, '[a-zA-Z]+(?:''[a-zA-Z]+)?')")
_words("words_bounded", T.words_bounded, K.bounded_words("text"))
_words("fold_analyzer", terms.fold_analyzer,
       r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}_]+'), lambda w: w<>'')")


@query("text_counts", f"select doc_id, len({K.words_ws('text')}) as words, len(text) as chars from documents")
def text_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count_ws(F.col("text")).alias("words"),
                                  F.length("text").alias("chars"))


@query("norm_term", f"select doc_id, {K.collapse('lower(text)')} as normed from documents")
def norm_term(spark, d):
    return _docs(spark, d).select("doc_id", T.norm_term(F.col("text")).alias("normed"))


@query("norm_alnum", f"select doc_id, regexp_replace({K.collapse('lower(text)')}, {K.rx('[^\\w\\s-]')}, '', 'g') as normed from documents")
def norm_alnum(spark, d):
    return _docs(spark, d).select("doc_id", T.norm_alnum(F.col("text")).alias("normed"))


@query("norm_ws_lower", f"select doc_id, lower({K.collapse('text')}) as normed from documents")
def norm_ws_lower(spark, d):
    return _docs(spark, d).select("doc_id", T.norm_ws_lower(F.col("text")).alias("normed"))


@query("norm_nospace", f"select doc_id, regexp_replace(lower(text), {K.rx('\\s+')}, '', 'g') as normed from documents")
def norm_nospace(spark, d):
    return _docs(spark, d).select("doc_id", T.norm_nospace(F.col("text")).alias("normed"))


_NUMS = "MAP {" + ", ".join(f"{K.q(a)}: {K.q(b)}" for a, b in rules.NUMBER_WORDS.items()) + "}"
_COUNTED = ("p_name||' '||case p_size%6 when 0 then 'One' when 1 then 'twelve' when 2 then 'twenty' when 3 then 'zero, nine'"
            " when 4 then 'Nineteen pills' else 'many' end")


@query("number_words_to_digits",
       f"select p_partkey, array_to_string(list_transform({K.words_ws('lower(t)')}, lambda w: coalesce({_NUMS}[w], w)), ' ')"
       f" as digits from (select p_partkey, {_COUNTED} t from part)")
def number_words(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_COUNTED).alias("t"))
    return p.select("p_partkey", T.number_words_to_digits(F.col("t")).alias("digits"))


@query("sanitize_keyword",
       f"select page_id, {K.collapse('regexp_replace(url, ' + K.q(rules.KEYWORD_METACHARS) + ', chr(0), chr(103))').replace('chr(0)', K.q('')).replace('chr(103)', K.q('g'))} as keyword from pages")
def sanitize_keyword(spark, d):
    return table(spark, d, "pages").select("page_id", T.sanitize_keyword(F.col("url")).alias("keyword"))


@query("preview", "select doc_id, case when len(text)>500 then left(text, 500)||'...' else text end as preview from documents")
def preview(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("slug", "select page_id, 'source-'||regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from pages")
def slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("content_density", r"select doc_id, round(coalesce(len(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))/nullif(len(text), 0), 0.0), 6) as density from documents")
def content_density(spark, d):
    return _docs(spark, d).select("doc_id", exact_round(T.content_density(F.col("text")), 6).alias("density"))


@query("count_syllables",
       f"select doc_id, list_sum(list_transform(w, lambda x: {K.syllables('x', True)})) as syllables_a,"
       f" list_sum(list_transform(w, lambda x: {K.syllables('x', False)})) as syllables_b"
       " from (select doc_id, regexp_extract_all(text, '[a-zA-Z]+(?:''[a-zA-Z]+)?') w from documents) where len(w)>0")
def count_syllables(spark, d):
    w = _docs(spark, d).select("doc_id", T.words_apostrophe(F.col("text")).alias("w")).filter(F.size("w") > 0)
    total = lambda le: F.aggregate(F.transform("w", lambda x: T.syllables(x, le)), F.lit(0).cast("int"), lambda a, x: a + x)
    return w.select("doc_id", total(True).cast("long").alias("syllables_a"), total(False).cast("long").alias("syllables_b"))


# ------------------------------------------------------------------- sections
def _lines(head: str) -> str:
    return f"""{REPORTS_SQL}, ln as (select pair_id, i-1 i, {K.strip('a[i]')} t, a[i] raw, len(a) n from
 (select pair_id, a, unnest(range(1, len(a)+1)) i from (select pair_id, string_split(original, chr(10)) a from reports))),
hd as (select pair_id, i, t, n, lead(i, 1, n) over (partition by pair_id order by i) nx from ln where {head})"""


_HEAD = "(" + " or ".join(f"regexp_matches(upper(t), {K.q(p)})" for p in rules.SECTION_HEADERS) + ")"
_LINES = _lines(_HEAD)


@query("detect_sections", f"with {_LINES} select pair_id, t as name, i as start_line, nx as end_line from hd")
def detect_sections(spark, d):
    s = reports(spark, d).select("pair_id", F.inline(sections.detect_sections(F.col("original"))))
    return s.select("pair_id", "name", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def _chunks(lines: str) -> str:
    return f"""with {lines},
secs as (select pair_id, i, nx, t from hd union all select pair_id, -1, min(i), null from hd group by 1
 union all select pair_id, -1, n, null from ln where i=0 and pair_id not in (select pair_id from hd)),
bodies as (select s.pair_id, s.i, s.t, {K.strip("coalesce(regexp_replace(s.t, '^[^:]+:', ''), '')||chr(10)||coalesce(string_agg(l.raw, chr(10) order by l.i), '')")} as content
 from secs s left join ln l on l.pair_id=s.pair_id and l.i>s.i and l.i<s.nx group by s.pair_id, s.i, s.t)
select pair_id, row_number() over (partition by pair_id order by i)-1 as chunk_index,
 upper(regexp_extract(t, '^([^:]+):', 1)) as title, content from bodies where i>=0 or content<>''"""


@query("chunk_by_section", _chunks(_LINES))
def chunk_by_section(spark, d):
    return sections.chunk_by_section(reports(spark, d), "original", ("pair_id",))


@query("chunk_by_section_packs", _chunks(_lines(f"case when pair_id%3=0 then {_HEAD} when pair_id%3=1 then regexp_matches(upper(t), '^(PLAN|MEDICATIONS):') else false end")))
def chunk_by_section_packs(spark, d):
    """Three sources with header rules of their own, from a table of rules; the third has none."""
    r = reports(spark, d).withColumn("source", F.concat(F.lit("source-"), F.pmod("pair_id", F.lit(3)).cast("string")))
    few = spark.createDataFrame([("source-1", 0, "^(plan|medications):", "i")], "pack string, ord int, pattern string, flags string")
    packs = {"source-0": rules.SECTION_HEADERS, **sections.read_packs(few)}
    return sections.chunk_by_section(r, "original", ("pair_id",), headers=(), packs=packs, pack="source")

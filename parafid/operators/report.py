"""Report, glossary and citation assembly.

A report, a glossary or a citation list is one value per document, so its
parts are gathered per document; nothing is gathered across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.rx import let, strip
from ..functions.text import preview

SOURCES = "array<struct<title:string,url:string,link:string,summary:string,highlights:array<string>>>"


#: What a training pair asks for, unless the caller says otherwise.
TRAINING_INSTRUCTION = "Rewrite the text in plain words and keep all facts and numbers."


def _ordered_join(order: str, value: Column, sep: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(parts, lambda x: x["v"]), sep)


def assemble_report(chunks: DataFrame, keys=("doc_id",), original: str = "original_chunk",
                    simplified: str = "simplified_chunk") -> DataFrame:
    """Chunks in order -> whole texts, preview, chunk count and review flag."""
    out = chunks.groupBy(*keys).agg(
        _ordered_join("chunk_index", F.col(simplified), "\n\n").alias("simplified_text"),
        _ordered_join("chunk_index", F.col(original), "\n\n").alias("original_text"),
        F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
        F.count(F.lit(1)).alias("chunks"))
    return out.withColumn("summary_text", preview(F.col("simplified_text")))


def merge_citations(chunks: DataFrame, keys=("doc_id",), citations: str = "citations") -> DataFrame:
    """Per document: source title -> segments in chunk order, titles by first appearance."""
    rows = chunks.select(*keys, "chunk_index", F.posexplode(F.map_entries(citations)).alias("pos", "e"))
    seg = F.struct("chunk_index", "pos", F.col("e.value").alias("segs"))
    per_title = rows.groupBy(*keys, F.col("e.key").alias("title")).agg(
        F.array_sort(F.collect_list(seg)).alias("parts"))
    return per_title.select(
        *keys, "title", F.flatten(F.transform("parts", lambda p: p["segs"])).alias("segments"),
        F.element_at("parts", 1)["chunk_index"].alias("first_chunk"), F.element_at("parts", 1)["pos"].alias("first_pos"))


def citation_map(merged: DataFrame, keys=("doc_id",)) -> DataFrame:
    """The merged citations as one map per document."""
    entry = F.struct("first_chunk", "first_pos", "title", "segments")
    return merged.groupBy(*keys).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["title"], e["segments"]))).alias("citations"))


def number_citations(merged: DataFrame, keys=("doc_id",)) -> DataFrame:
    """1..n by first appearance within the document."""
    w = Window.partitionBy(*keys).orderBy("first_chunk", "first_pos", "title")
    return merged.withColumn("number", F.row_number().over(w))


def parse_sources(c: Column) -> Column:
    return F.coalesce(F.from_json(c, SOURCES), F.expr(f"cast(array() as {SOURCES})"))


def project_sources(c: Column) -> Column:
    """Title, url (or link) and summary with defaults."""
    return F.transform(parse_sources(c), lambda s: F.struct(
        F.coalesce(s["title"], F.lit("Untitled")).alias("title"),
        F.coalesce(s["url"], s["link"], F.lit("")).alias("url"),
        F.coalesce(s["summary"], F.lit("No summary available")).alias("summary")))


def format_sources(c: Column, sources: int | None = 5, highlights: int | None = 3, summary_chars: int | None = 300) -> Column:
    """Prompt block of the first sources with excerpts and summaries; None sets no limit."""
    def first(a: Column, n: int | None) -> Column:
        return a if n is None else F.slice(a, 1, n)

    def one(s: Column) -> Column:
        excerpts = F.when(F.size(F.coalesce(s["highlights"], F.expr("cast(array() as array<string>)"))) > 0,
                          F.array_join(first(s["highlights"], highlights), " | ")).otherwise("No highlights")
        summary = F.coalesce(s["summary"], F.lit("No summary"))
        return F.concat(F.lit("- **"), F.coalesce(s["title"], F.lit("Untitled")), F.lit("**\n  Summary: "),
                        summary if summary_chars is None else F.left(summary, F.lit(summary_chars)),
                        F.lit("\n  Key excerpts: "), excerpts)
    return let(parse_sources(c), lambda a: F.when(F.size(a) == 0, F.lit("No sources available.")).otherwise(
        F.array_join(F.transform(first(a, sources), one), "\n\n")))


# ------------------------------------------------------------------ glossary


def glossary_terms(original: Column, simplified: Column, max_terms: int | None = rules.GLOSSARY_MAX_TERMS,
                   acronyms_only: bool = False) -> Column:
    both = F.array_union(extract.glossary_candidates(original, acronyms_only),
                         extract.glossary_candidates(simplified, acronyms_only))
    return F.array_sort(both) if max_terms is None else F.slice(F.array_sort(both), 1, max_terms)


def build_glossary(df: DataFrame, definitions: DataFrame | None = None, keys=("doc_id",),
                   max_terms: int | None = rules.GLOSSARY_MAX_TERMS, acronyms_only: bool = False) -> DataFrame:
    """Ordered glossary rows; terms without a definition row get the default text.

    ``definitions``: term, definition, category - joined on the term, any size.
    """
    rows = df.select(*keys, F.posexplode(glossary_terms(
        F.col("original"), F.col("simplified"), max_terms, acronyms_only)).alias("pos", "term"))
    if definitions is None:
        return rows.withColumns({"definition": F.lit(rules.MISSING_DEFINITION),
                                 "category": F.lit(rules.DEFAULT_CATEGORY)})
    d = definitions.select("term", F.lit(True).alias("_hit"), "definition", "category")
    j = rows.join(d, "term", "left")
    return j.select(
        *keys, "pos", "term",
        F.when(F.col("_hit").isNull(), rules.MISSING_DEFINITION).otherwise(
            F.coalesce("definition", F.lit(rules.DEFAULT_DEFINITION))).alias("definition"),
        F.coalesce("category", F.lit(rules.DEFAULT_CATEGORY)).alias("category"))


def _looks_medical(term: Column, category: Column) -> Column:
    low = F.trim(F.lower(term))
    affix = low.rlike("|".join(rules.GLOSSARY_AFFIXES))
    return (F.lower(category).isin(rules.GLOSSARY_CATEGORIES) | affix | term.rlike(r"^[A-Z]{2,5}\z")
            | (F.length(low) > 8) | (F.regexp_count(low, F.lit("[aeiouy]+")) >= 3))


def filter_glossary(glossary: DataFrame, common_words: DataFrame) -> DataFrame:
    """Terms worth showing.  ``common_words(word)`` is the caller's everyday-word table."""
    low = F.trim(F.lower("term"))
    plain = glossary.filter((F.length(low) >= 3) & ~low.rlike(r"^\d+\z") & ~low.rlike(r"^(mg|ml|mcg|units?)\z")
                            & _looks_medical(F.col("term"), F.col("category")))
    return plain.withColumn("_low", low).join(
        common_words.select(F.lower("word").alias("_low")).distinct(), "_low", "left_anti").drop("_low")


def search_glossary(glossary: DataFrame, query: str) -> DataFrame:
    """Case-insensitive search over term, definition and category, sorted by term."""
    q = query.lower()
    hit = F.lit(True) if not q.strip() else (
        F.lower("term").contains(q) | F.lower("definition").contains(q) | F.lower("category").contains(q))
    return glossary.filter(hit).orderBy(F.lower("term"), "term")


def _quoted(term: Column) -> Column:
    """``term`` as a literal inside a pattern, whatever it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


# ----------------------------------------------------------------- citations


def link_inline_citations(text: Column, citations: Column) -> Column:
    """Wrap ``[Title]`` mentions in numbered markers, longest title first.

    ``citations``: ``array<struct<title,number>>``.
    """
    ordered = F.array_sort(F.transform(citations, lambda c: F.struct(
        (-F.length(c["title"])).alias("neg"), c["number"].alias("number"), c["title"].alias("title"))))

    def mark(acc: Column, c: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)\["), _quoted(c["title"]), F.lit(r"\]"))
        safe = F.regexp_replace(c["title"], r"([\\$])", r"\\$1")
        return F.regexp_replace(acc, pattern, F.concat(
            F.lit("%%CITE_START_"), c["number"].cast("string"), F.lit("_"), safe, F.lit("%%$0%%CITE_END%%")))

    return F.aggregate(ordered, text, mark)


def citation_mentions(text: Column, citations: Column) -> Column:
    """``array<struct<title,number,mentions>>`` for the titles that occur in brackets."""
    low = F.lower(text)
    counted = F.transform(citations, lambda c: F.struct(
        c["title"].alias("title"), c["number"].alias("number"),
        F.regexp_count(low, F.concat(F.lit(r"\["), _quoted(F.lower(c["title"])), F.lit(r"\]"))).alias("mentions")))
    return F.filter(counted, lambda c: c["mentions"] > 0)


def highlight_spans(text: Column, terms: Column) -> Column:
    """Non-overlapping whole-word term spans: longest term first, then ordered by start.

    ``array<struct<start,end,term>>`` with 0-based offsets. Patterns run only for terms whose letters occur in the
    text, so a long list costs a search for each term, not a pattern.
    """
    kind = "array<struct<start:int,end:int,term:string>>"
    ordered = F.transform(F.array_sort(F.transform(F.array_remove(F.array_distinct(terms), ""), lambda t, i: F.struct(
        (-F.length(t)).alias("neg"), i.alias("i"), t.alias("t")))), lambda x: x["t"])

    def hits(low: Column, t: Column) -> Column:
        # a match starts after a boundary and ends before one; offsets by gap lengths
        pat = F.concat(F.lit(r"(?U)\b"), _quoted(F.lower(t)), F.lit(r"\b"))
        gaps = F.split(low, pat, -1)
        n = F.length(t)
        starts = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.aggregate(
            F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)) + (i - 1) * n)
        return F.transform(F.slice(starts, F.lit(1), F.size(gaps) - 1), lambda p: F.struct(
            p.alias("start"), (p + n).alias("end"), t.alias("term")))

    def fold(low: Column) -> Column:
        return F.aggregate(F.flatten(F.transform(F.filter(ordered, lambda t: F.contains(low, F.lower(t))), lambda t: hits(low, t))), F.expr(f"cast(array() as {kind})"),
                           lambda acc, m: F.when(F.exists(acc, lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"])),
                                                 acc).otherwise(F.concat(acc, F.array(m))))
    return F.array_sort(let(F.lower(text), fold))


def highlight_segments(text: Column, marks: Column) -> Column:
    """Text cut at the spans: ``array<struct<text,is_term>>``."""
    def piece(a: Column, b: Column, term: bool) -> Column:
        return F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(term).alias("is_term"))

    cut = F.flatten(F.transform(marks, lambda m, i: F.array(
        piece(F.coalesce(F.try_element_at(marks, F.when(i > 0, i))["end"], F.lit(0)), m["start"], False),
        piece(m["start"], m["end"], True))))
    tail = F.array(piece(F.coalesce(F.try_element_at(marks, F.lit(-1))["end"], F.lit(0)), F.length(text), False))
    return F.filter(F.concat(cut, tail), lambda p: p["text"] != "")


# --------------------------------------------------------------- nested ideas
IDEAS = "struct<main_ideas:array<struct<main_idea:string,details:array<struct<detail:string>>>>>"
SIMPLE_IDEAS = ("struct<simplified_main_ideas:array<struct<original_main_idea:string,simplified_main_idea:string,"
                "original_details:array<string>,simplified_details:array<struct<original_detail:string,"
                "simplified_detail:string>>>>>")


def flatten_main_ideas(df: DataFrame, report: str = "report", keys=("doc_id",)) -> DataFrame:
    """(idea, detail) rows; an idea without details keeps one row."""
    ideas = df.select(*keys, F.posexplode_outer(f"{report}.main_ideas").alias("idea_no", "i"))
    return ideas.select(*keys, "idea_no", F.col("i.main_idea").alias("main_idea"),
                        F.posexplode_outer("i.details").alias("detail_no", "d")).select(
        *keys, "idea_no", "main_idea", "detail_no", F.col("d.detail").alias("detail"))


def simplified_content(report: Column) -> Column:
    """Simplified side only, as JSON."""
    return F.to_json(F.transform(report["simplified_main_ideas"], lambda i: F.struct(
        i["simplified_main_idea"].alias("main_idea"),
        F.transform(i["simplified_details"], lambda d: d["simplified_detail"]).alias("details"))))


def build_prompts(template: str, **parts) -> Column:
    """Fill ``{name}`` slots of a caller's template with columns."""
    out, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest]
        if not hits:
            out.append(F.lit(rest))
            break
        at, k = min(hits)
        out += [F.lit(rest[:at]), F.coalesce(parts[k].cast("string"), F.lit(""))]
        rest = rest[at + len(k) + 2:]
    return F.concat(*out)


def assemble_pages(pages: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Page texts in order; a failed page leaves a placeholder, a blank document a reason."""
    text = F.coalesce("text", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(" extraction failed: "),
                                       F.coalesce("error", F.lit("unknown")), F.lit("]")))
    out = pages.groupBy(*keys).agg(_ordered_join("page", text, "\n\n").alias("text"), F.count(F.lit(1)).alias("pages"))
    return out.withColumn("reject_reason", F.when(strip(F.col("text")) == "", "no text extracted"))


def training_pairs(df: DataFrame, source: str = "original_text", target: str = "plain_language_text",
                   instruction: str = TRAINING_INSTRUCTION) -> DataFrame:
    """Instruction + text prompt and its target, tagged with the split."""
    return df.select("*", F.concat(F.lit(instruction + "\n\nText:\n"), F.col(source), F.lit("\n\nSimplified:"))
                     .alias("input_text"), F.col(target).alias("target_text"))



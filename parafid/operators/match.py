"""Sentence and fact alignment.

A pair's sentences already sit in one row, so alignment is evaluated inside
the row with higher-order functions: no shuffle, no self join, and no pair is
ever emitted - only the winners are exploded.  Work per row is bounded by the
row's own text, so a hot key cannot form a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.rx import find_all, let, literal_words, once
from ..functions.sets import exact_round, ratio
from ..functions.text import norm_alnum, number_words_to_digits, sentences_expanded, words_ws

NO_STRINGS = "cast(array() as array<string>)"


def sentence_features(sentences: Column, entities=None) -> Column:
    """Per sentence: text plus the word, number, drug and entity sets."""
    return F.transform(sentences, lambda s: F.struct(
        s.alias("text"),
        F.array_distinct(words_ws(F.lower(s))).alias("words"),
        extract.number_values(s).alias("numbers"),
        extract.extract_drug_names(s).alias("drugs"),
        (entities(s) if entities else F.expr(NO_STRINGS)).alias("entities")))


def _overlap(a: Column, b: Column) -> Column:
    """Jaccard from one intersection: i / (|a| + |b| - i), 0 when nothing is shared."""
    shared = let(F.size(F.array_intersect(a, b)),
                 lambda i: ratio(i, F.nullif(F.size(a) + F.size(b) - i, F.lit(0)), 0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared).otherwise(F.lit(0.0))


def _match_score(o: Column, s: Column, least: float) -> Column:
    """Weighted overlaps; 0 where the words, the longest sets, could not lift the others' part to ``least``."""
    found = (F.lit(0.35) * _overlap(s["drugs"], o["drugs"])
             + F.lit(0.25) * _overlap(s["numbers"], o["numbers"])
             + F.lit(0.25) * _overlap(s["entities"], o["entities"]))
    return let(found, lambda x: F.when(x + F.lit(0.15) >= least, x + F.lit(0.15) * _overlap(s["words"], o["words"])).otherwise(F.lit(0.0)))


def best_matches(orig: Column, simp: Column, min_similarity: float) -> Column:
    """For each simplified sentence the first best original sentence, or null.

    ``array<struct<pos,sentence,match_pos,match,score,shares_content>>``
    """

    def winner(s: Column) -> Column:
        return F.array_max(F.transform(orig, lambda o, j: F.struct(
            _match_score(o, s, min_similarity).alias("score"), (-j).alias("neg"))))

    def shares(o: Column, s: Column) -> Column:
        return (F.arrays_overlap(o["drugs"], s["drugs"]) | F.arrays_overlap(o["numbers"], s["numbers"])
                | F.arrays_overlap(o["entities"], s["entities"]))

    def row(s: Column, i: Column) -> Column:
        def build(w: Column) -> Column:
            ok = (w["score"] >= min_similarity) & (w["score"] > 0)
            hit = F.try_element_at(orig, F.when(ok, 1 - w["neg"]))
            return F.struct(
                i.alias("pos"), s["text"].alias("sentence"),
                F.when(ok, -w["neg"]).alias("match_pos"), hit["text"].alias("match"),
                F.when(ok, w["score"]).otherwise(F.lit(0.0)).alias("score"),
                F.coalesce(F.when(ok, shares(hit, s)), F.lit(False)).alias("shares_content"))
        return let(winner(s), build)

    return F.transform(simp, row)


def best_sentence_match(df: DataFrame, min_similarity: float = rules.MIN_MATCH_SCORE, *,
                        keys=("pair_id",), entities=None, split=sentences_expanded) -> DataFrame:
    """One row per simplified sentence with its best original sentence."""
    staged = df.select(*keys, sentence_features(split(F.col("original")), entities).alias("_o"),
                       sentence_features(split(F.col("simplified")), entities).alias("_s"))
    return staged.select(*keys, F.inline(best_matches(F.col("_o"), F.col("_s"), min_similarity)))


def premise_words(c: Column) -> Column:
    return F.array_except(find_all(F.lower(c), r"\b\w+\b"), literal_words(rules.PREMISE_STOP_WORDS))


def best_premise(query: Column, sentences: Column, fallback: Column, fallback_chars: int | None = 1000,
                 words: Column | None = None) -> Column:
    """First sentence with the highest stop-word-free Jaccard, else the source's first ``fallback_chars`` (None: all).

    ``words``: ``premise_words`` of each sentence, if the caller has several queries for them.
    """
    rest = fallback if fallback_chars is None else F.left(fallback, F.lit(fallback_chars))
    words = F.transform(sentences, premise_words) if words is None else words

    def choose(q: Column) -> Column:
        scored = F.array_max(F.transform(words, lambda c, j: F.struct(
            _overlap(q, c).alias("score"), (-j).alias("neg"))))
        return let(scored, lambda w: F.when(
            w["score"] > 0, F.try_element_at(sentences, 1 - w["neg"])))
    return F.coalesce(let(premise_words(query), choose), rest)


def greedy_embedding_match(df: DataFrame, cand: str = "candidate", ref: str = "reference",
                           keys=("pair_id",)) -> DataFrame:
    """Token-embedding precision / recall / F1: each vector takes its best cosine on the other side.

    ``cand`` and ``ref`` are arrays of vectors held by the row.
    """
    from ..functions.sets import dot, unit_vector
    staged = df.select(*keys, F.transform(cand, unit_vector).alias("_c"), F.transform(ref, unit_vector).alias("_r"))

    def mean_best(a: Column, b: Column) -> Column:
        best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
        total = F.aggregate(best, F.lit(0.0), lambda s, v: s + v)
        return F.coalesce(F.try_divide(total, F.size(a)), F.lit(0.0))

    scored = staged.select(*keys, mean_best(F.col("_c"), F.col("_r")).alias("precision"),
                           mean_best(F.col("_r"), F.col("_c")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, F.nullif(p + r, F.lit(0.0)), 0.0))


# ------------------------------------------------------------ propositions
PROP_JSON = "array<struct<text:string,category:string,assertion:string,normalized:string>>"


def parse_propositions(c: Column, prefix: str) -> Column:
    """Model JSON -> ``array<struct<id,text,category,assertion,normalized>>`` with defaults."""
    from ..sources.readers import parse_model_json
    return F.transform(parse_model_json(c, PROP_JSON), lambda p, i: let(F.coalesce(p["text"], F.lit("")), lambda t: F.struct(
        F.concat(F.lit(prefix + "_"), (i + 1).cast("string")).alias("id"), t.alias("text"),
        F.coalesce(p["category"], F.lit("finding")).alias("category"),
        F.coalesce(p["assertion"], F.lit("present")).alias("assertion"),
        F.coalesce(p["normalized"], F.lower(t)).alias("normalized"))))


def fact_words(c: Column, canonicalize=None) -> Column:
    """Word set of a fact: normalised words plus those of its canonical form."""
    plain = words_ws(number_words_to_digits(norm_alnum(c)))
    if canonicalize is None:
        return F.array_distinct(plain)
    return F.array_union(plain, words_ws(number_words_to_digits(norm_alnum(canonicalize(c)))))


def synonym_keys(words: Column, extra: Column | None = None) -> Column:
    """``array<struct<w,k>>``: each word with the key of its synonym group (itself if none).

    ``extra`` is an optional map word -> key from a terminology; it wins over
    the fixed fallback groups.
    """
    pairs = [(t, min(g, key=len)) for g in rules.FALLBACK_SYNONYMS for t in g if " " not in t]
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    known = lambda w: F.when(w.isin([t for t, _ in pairs]), F.try_element_at(table, w))
    return F.transform(words, lambda w: F.coalesce(
        *([F.try_element_at(extra, w)] if extra is not None else []), known(w), w))


def dice(words_a: Column, keys_a: Column, words_b: Column, keys_b: Column) -> Column:
    """(words of a with a synonym in b + words of b with one in a) / (|a| + |b|)."""
    counted = (F.size(F.filter(keys_a, lambda k: F.array_contains(keys_b, k)))
               + F.size(F.filter(keys_b, lambda k: F.array_contains(keys_a, k))))
    total = F.size(words_a) + F.size(words_b)
    return F.when((F.size(words_a) > 0) & (F.size(words_b) > 0), counted / total).otherwise(F.lit(0.0))


def _fact_dice(a: Column, b: Column) -> Column:
    """``dice`` on prepared sides; one hashed intersection when no key repeats within a side."""
    both = F.size(F.array_intersect(a["keys"], b["keys"]))
    return F.when(a["unique"] & b["unique"] & (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0),
                  2 * both / (F.size(a["words"]) + F.size(b["words"]))).otherwise(
        dice(a["words"], a["keys"], b["words"], b["keys"]))


def dice_similarity(a: Column, b: Column, canonicalize=None, synonyms: Column | None = None) -> Column:
    sides = F.struct(fact_words(a, canonicalize).alias("a"), fact_words(b, canonicalize).alias("b"))
    return let(sides, lambda s: let(
        F.struct(synonym_keys(s["a"], synonyms).alias("a"), synonym_keys(s["b"], synonyms).alias("b")),
        lambda k: dice(s["a"], k["a"], s["b"], k["b"])))


def _fact_features(props: Column, synonyms, canonicalize) -> Column:
    def side(c: Column) -> Column:
        return let(fact_words(c, canonicalize), lambda w: let(synonym_keys(w, synonyms), lambda k: F.struct(
            w.alias("words"), k.alias("keys"), (F.size(k) == F.size(F.array_distinct(k))).alias("unique"))))
    return F.transform(props, lambda p: F.struct(
        p["id"].alias("id"), p["text"].alias("text"), p["category"].alias("category"),
        p["assertion"].alias("assertion"), side(p["normalized"]).alias("n"), side(p["text"]).alias("t")))


def align_propositions(df: DataFrame, source: str = "source_props", summary: str = "summary_props", *,
                       keys=("doc_id",), threshold: float = rules.ALIGN_THRESHOLD,
                       synonyms: Column | None = None, canonicalize=None, top: int | None = 3) -> DataFrame:
    """Adds ``alignments``: per summary fact the best ``top`` source facts (None: all above the threshold) and a match type.

    What is beyond ``top`` counts as not matched in ``linkage_report``.
    """
    features = F.struct(_fact_features(F.col(source), synonyms, canonicalize).alias("src"),
                        _fact_features(F.col(summary), synonyms, canonicalize).alias("sum"))

    def score(a: Column, b: Column) -> Column:
        return F.greatest(*[_fact_dice(a[x], b[x]) for x in "nt"])

    def align(src: Column, s: Column) -> Column:
        ranked = F.array_sort(F.filter(
            F.transform(src, lambda o, j: F.struct(
                (-score(s, o)).alias("neg"), j.alias("pos"), o["id"].alias("id"),
                o["assertion"].alias("assertion"), o["text"].alias("text"))),
            lambda m: -m["neg"] >= threshold))
        if top is not None:
            ranked = F.slice(ranked, 1, top)

        def build(best: Column) -> Column:
            conf = F.coalesce(-F.try_element_at(best, F.lit(1))["neg"], F.lit(0.0))
            kind = (F.when(F.size(best) == 0, "none").when(conf > rules.EXACT_MATCH, "exact")
                    .when(conf > rules.SEMANTIC_MATCH, "semantic").otherwise("partial"))
            first = F.try_element_at(best, F.lit(1))
            return F.struct(
                s["id"].alias("summary_id"), s["text"].alias("summary_text"),
                s["category"].alias("category"), s["assertion"].alias("summary_assertion"),
                F.transform(best, lambda m: m["id"]).alias("source_ids"), kind.alias("match_type"),
                conf.alias("confidence"), first["id"].alias("source_id"),
                first["text"].alias("source_text"), first["assertion"].alias("source_assertion"))
        return let(ranked, build)

    # bound once: a staged column used inside a lambda could be computed again per element
    return df.select(*keys, source, summary, let(
        features, lambda x: F.transform(x["sum"], lambda s: align(x["src"], s))).alias("alignments"))


def assertion_mismatches(aligned: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Facts aligned with confidence > 0.5 whose assertion differs from the best source fact."""
    a = aligned.select(*keys, F.inline(once(F.col("alignments"))))
    return a.filter((F.col("confidence") > rules.SEMANTIC_MATCH)
                    & (F.col("summary_assertion") != F.col("source_assertion"))).select(
        *keys, "summary_id", "summary_text", "source_id", "source_text", "source_assertion",
        "summary_assertion")


def linkage_report(aligned: DataFrame, source: str = "source_props", summary: str = "summary_props",
                   keys=("doc_id",)) -> DataFrame:
    """Coverage, hallucination rate, missing and unsupported facts, all inside the row."""
    matched = F.array_distinct(F.flatten(F.transform("alignments", lambda a: a["source_ids"])))
    staged = aligned.select(*keys, source, summary, "alignments", matched.alias("_m"))
    missing = F.filter(source, lambda p: ~F.array_contains(F.col("_m"), p["id"]))
    unsupported = F.filter("alignments", lambda a: F.size(a["source_ids"]) == 0)
    n_src, n_sum = F.size(source), F.size(summary)
    return staged.select(
        *keys,
        exact_round(ratio(F.size("_m"), F.nullif(n_src, F.lit(0)), 1.0), 4).alias("coverage_score"),
        exact_round(ratio(F.size(unsupported), F.nullif(n_sum, F.lit(0)), 0.0), 4).alias("hallucination_rate"),
        n_src.alias("total_source_props"), n_sum.alias("total_summary_props"),
        F.size("_m").alias("matched_source_props"), (n_src - F.size("_m")).alias("unmatched_source_props"),
        F.size(unsupported).alias("unsupported_summary_props"),
        missing.alias("missing_facts"),
        F.transform(unsupported, lambda a: F.struct(
            a["summary_id"].alias("id"), a["summary_text"].alias("text"),
            a["category"].alias("category"))).alias("potential_hallucinations"))


def cited_sources(citations: DataFrame, sources: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Numbered citations joined to the first source carrying that title.

    ``citations``: keys + title, number; ``sources``: keys + title, ord, url, summary.
    ``min_by`` combines map-side, so repeated titles never travel as rows.
    """
    first = sources.groupBy(*keys, "title").agg(
        F.min_by(F.struct("url", "summary"), "ord").alias("_f"))
    return citations.join(first, [*keys, "title"]).select(
        *keys, "title", F.col("number").alias("citation_number"), "_f.url", "_f.summary")

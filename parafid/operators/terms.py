"""Terminology: building it from delimited rows, and looking terms up in it.

Sizes: the terminology may hold millions of rows and is never broadcast or
collected; every lookup starts from the *distinct* terms.  Whatever has to be
gathered per concept is made distinct first, so repeated rows collapse before
they are shuffled.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.rx import find_all, has, let, literal_words, once
from ..functions.text import norm_term, words_ws
from ..plans.checkpoints import cut
from .postings import TermIndex

# ---------------------------------------------------------------------- build


def semantic_types_by_cui(mrsty: DataFrame) -> DataFrame:
    """CUI -> ordered ``array<struct<tui,sty>>``; ``ord`` is the file order."""
    return mrsty.groupBy(F.col("CUI").alias("cui")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "TUI", "STY"))),
        lambda x: F.struct(x["TUI"].alias("tui"), x["STY"].alias("sty"))).alias("semantic_types"))


def definitions_by_cui(mrdef: DataFrame, limit: int | None = None) -> DataFrame:
    """CUI -> distinct unsuppressed definitions in file order; the first ``limit`` if given.

    Duplicates fold map-side into their first position. With a limit, the rank
    limit runs before the shuffle, so at most that many rows per task leave for a concept.
    """
    kept = mrdef.filter((F.col("SUPPRESS") != "Y") & (F.col("DEF") != ""))
    first = kept.groupBy("CUI", "DEF").agg(F.min("ord").alias("ord"))
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("CUI").orderBy("ord"))
        first = first.withColumn("rn", rank).filter(F.col("rn") <= limit)
    return first.groupBy(F.col("CUI").alias("cui")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "DEF"))), lambda x: x["DEF"]).alias("definitions"))


def _active(mrconso: DataFrame, languages) -> DataFrame:
    kept = mrconso.filter(F.col("SUPPRESS") != "Y")
    return kept.filter(F.col("LAT").isin(list(languages))) if languages else kept


def build_concepts(mrconso: DataFrame, semantic_types: DataFrame | None = None,
                   definitions: DataFrame | None = None, languages=None) -> DataFrame:
    """One row per concept: preferred term, sorted terms, sources, languages, types, definitions."""
    rows = _active(mrconso, languages)
    preferred = (F.col("TS") == "P") & (F.col("ISPREF") == "Y") & (F.col("LAT") == "ENG")
    # first fold: one row per (concept, string, source, language)
    folded = rows.groupBy(F.col("CUI").alias("cui"), "STR", "SAB", "LAT").agg(
        F.min(F.when(preferred & (F.col("STR") != ""), F.col("ord"))).alias("pref"))
    out = folded.groupBy("cui").agg(
        F.min(F.when(F.col("pref").isNotNull(), F.struct("pref", "STR"))).alias("_p"),
        F.min("STR").alias("_any"),
        F.array_sort(F.collect_set("STR")).alias("terms"), F.array_sort(F.collect_set("SAB")).alias("sources"),
        F.array_sort(F.collect_set("LAT")).alias("languages"))
    out = out.withColumn("preferred_term", F.coalesce("_p.STR", "_any")).drop("_p", "_any")
    out = out.join(definitions, "cui", "left") if definitions is not None else out.withColumn(
        "definitions", F.expr("cast(null as array<string>)"))
    out = out.join(semantic_types, "cui", "left") if semantic_types is not None else out.withColumn(
        "semantic_types", F.expr("cast(null as array<struct<tui:string,sty:string>>)"))
    return out.select(
        "cui", "preferred_term", "terms",
        F.coalesce("definitions", F.expr("cast(array() as array<string>)")).alias("definitions"),
        F.coalesce("semantic_types", F.expr("cast(array() as array<struct<tui:string,sty:string>>)"))
        .alias("semantic_types"), "sources", "languages")


def build_synonyms(mrconso: DataFrame, semantic_types: DataFrame | None = None, languages=None) -> DataFrame:
    """First row in file order per (concept, lower-cased term), with the concept's TUIs.

    ``min_by`` folds duplicates map-side, so a hot concept is never sorted in one task.
    """
    rows = _active(mrconso, languages)
    fields = F.struct("STR", "TS", "ISPREF", "LAT", "SAB", "TTY", "ord")
    first = rows.groupBy(F.col("CUI").alias("cui"), F.lower("STR").alias("term_lower")).agg(
        F.min_by(fields, "ord").alias("r"))
    out = first.select(
        "cui", F.col("r.STR").alias("term"), "term_lower",
        ((F.col("r.TS") == "P") & (F.col("r.ISPREF") == "Y")).alias("is_preferred"),
        F.col("r.LAT").alias("language"), F.col("r.SAB").alias("source"), F.col("r.TTY").alias("term_type"),
        F.col("r.ord").alias("ord"))
    none = F.expr("cast(array() as array<string>)")
    if semantic_types is None:
        return out.withColumn("semantic_types", none)
    tuis = semantic_types.select("cui", F.transform("semantic_types", lambda t: t["tui"]).alias("semantic_types"))
    return out.join(tuis, "cui", "left").withColumn("semantic_types", F.coalesce("semantic_types", none))


# --------------------------------------------------------------------- lookup

K1, B = 1.2, 0.75
BOOST_EXACT, BOOST_PHRASE = 10.0, 5.0


def fold_analyzer(c: Column) -> Column:
    """Lower, fold accents to ASCII, split into alphanumeric tokens."""
    low = F.lower(c)
    folded = F.when(low.rlike(r"[^\x00-\x7f]"), F.regexp_replace(
        F.translate(low, _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")).otherwise(low)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters -> base letter, by canonical decomposition."""
    pairs = [(ch, unicodedata.normalize("NFD", ch)[0]) for ch in map(chr, range(0xC0, 0x250)) if ch == ch.lower()]
    pairs = [(a, b) for a, b in pairs if b.isascii()] + [("ø", "o"), ("ł", "l"), ("đ", "d")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _fold_table()


def lookup_terms(terms: DataFrame, synonyms: DataFrame | TermIndex, limit: int = 10,
                 min_score: float = 0.0) -> DataFrame:
    """Ranked synonym rows for every distinct non-blank ``term``.

    With a stored index (``postings.write_index``) in place of the synonyms, nothing is tokenised or counted again and
    only the index's blocks that can hold a result are read.

    score = 10 if the lower-cased strings are equal + 5 if the term's tokens
    occur as a phrase + BM25 of the term's tokens.  Rows above ``min_score``
    are ranked (score desc, preferred first, ord) and cut at ``limit``.

    Candidates come in tiers. Equality, phrases (the token n-gram with the
    query's own length) and each term's best token come first; a term that has
    ``limit`` rows by then has a bar, the score of the last of them. Other tokens
    make candidates only where their best contributions, counted over what the
    synonyms really hold, can add up to the bar: what they cannot lift over it
    would not be among the first ``limit``. This is exact, not a cap, and keeps
    a token that very many synonyms hold out of the join.
    """
    if isinstance(synonyms, TermIndex):
        return synonyms.lookup(terms, limit, min_score)
    q, s, qw, avgdl = _prepared(terms, synonyms)
    first = cut(_scored(_first_tier(q, s, qw), s, qw, avgdl).filter(F.col("score") > min_score))
    more = _second_tier(qw, s, _bars(first, limit), min_score).join(first.select("term", "cui", "term_lower"), ["term", "cui", "term_lower"], "left_anti")
    scored = first.unionByName(_scored(more, s, qw, avgdl).filter(F.col("score") > min_score))
    return _ranked(scored, limit).select("term", "rank", "score", "cui", "syn_term", "is_preferred", "semantic_types")


def asked(terms: DataFrame) -> DataFrame:
    """Distinct non-blank terms, lower-cased and tokenised."""
    q = terms.select("term").distinct().filter(F.trim(F.regexp_replace("term", r"(?U)\s+", " ")) != "")
    return q.withColumn("q_lower", F.trim(F.lower("term"))).withColumn("q_tokens", fold_analyzer(F.col("term")))


def _prepared(terms: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """Tokenised terms and synonyms (stored), the terms with their tokens' weights, mean synonym length."""
    q = cut(asked(terms))
    s = cut(synonyms.withColumn("s_tokens", fold_analyzer(F.col("term"))).withColumnRenamed("term", "syn_term"))
    n, avgdl = s.agg(F.count(F.lit(1)), F.avg(F.size("s_tokens"))).first()
    n, avgdl = F.lit(n), F.lit(float(avgdl or 1.0))
    # document frequency and best term-frequency part, only of tokens the queries use
    q_tok = q.select("term", F.explode(F.array_distinct("q_tokens")).alias("token"))
    posted = s.select("s_tokens", F.explode(F.array_distinct("s_tokens")).alias("token")).join(
        q_tok.select("token").distinct(), "token", "left_semi")
    tf, dl = F.size(F.filter("s_tokens", lambda t: t == F.col("token"))), F.size("s_tokens")
    df_ = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max(_saturation(tf, dl, avgdl)).alias("part"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = q_tok.join(df_.select("token", idf.alias("idf"), (idf * F.col("part")).alias("best")), "token").groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct("best", "idf", "token"))).alias("weights"))
    return q, s, cut(q.join(weights, "term", "left")), avgdl


def _saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _by_token(wanted: DataFrame, s: DataFrame) -> DataFrame:
    """(term, cui, term_lower) of synonyms with a token of ``wanted`` (term, token)."""
    return wanted.join(s.select("cui", "term_lower", F.explode(F.array_distinct("s_tokens")).alias("token")), "token").select(
        "term", "cui", "term_lower")


def _first_tier(q: DataFrame, s: DataFrame, qw: DataFrame) -> DataFrame:
    """Equal strings, phrases, and rows with the term's best token."""
    by_exact = q.select("term", F.col("q_lower").alias("term_lower")).join(
        s.select("cui", "term_lower"), "term_lower").select("term", "cui", "term_lower")
    grams = q.filter(F.size("q_tokens") > 0).select("term", F.size("q_tokens").alias("len"), F.array_join("q_tokens", " ").alias("gram"))
    longest = grams.agg(F.max("len")).first()[0] or 0
    held = s.select("cui", "term_lower", F.explode(ngrams(F.col("s_tokens"), longest)).alias("gram")) if longest else \
        s.select("cui", "term_lower", F.lit("").alias("gram")).filter(F.lit(False))
    by_phrase = grams.join(held, "gram").select("term", "cui", "term_lower")
    best = _by_token(qw.select("term", F.element_at("weights", -1)["token"].alias("token")).filter("token is not null"), s)
    return by_exact.unionByName(by_phrase).unionByName(best).distinct()


def _bars(first: DataFrame, limit: int) -> DataFrame:
    """(term, bar): the ``limit``-th best score of terms that have as many rows."""
    return _ranked(first, limit).filter(F.col("rank") == limit).select("term", F.col("score").alias("bar"))


def _second_tier(qw: DataFrame, s: DataFrame, bar: DataFrame, min_score: float) -> DataFrame:
    """Rows with one of the other tokens that may still matter.

    Tokens are in order of their best contribution; while the sum up to a token
    stays below the bar, rows with nothing above it cannot reach the bar.
    """
    b = F.greatest(F.coalesce("bar", F.lit(min_score)), F.lit(min_score)) - 1e-9
    reach = F.transform("weights", lambda w, i: F.struct(w["token"].alias("token"), F.aggregate(
        F.slice("weights", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x["best"]).alias("sum")))
    others = F.slice(F.filter(reach, lambda r: r["sum"] >= b), 1, F.greatest(
        F.size(F.filter(reach, lambda r: r["sum"] >= b)) - 1, F.lit(0)))
    wanted = qw.join(bar, "term", "left").select("term", F.explode(F.transform(others, lambda r: r["token"])).alias("token"))
    return _by_token(wanted, s).distinct()


def _scored(cand: DataFrame, s: DataFrame, qw: DataFrame, avgdl: Column) -> DataFrame:
    full = cand.join(s, ["cui", "term_lower"]).join(qw, "term")
    return full.withColumn("score", _score(avgdl)).select("term", "cui", "term_lower", "score", "syn_term", "is_preferred", "ord", "semantic_types")


def _score(avgdl: Column) -> Column:
    """Score of a row that holds a term (``q_lower, q_tokens, weights``) and a synonym (``term_lower, s_tokens``)."""
    dl = F.size("s_tokens")
    weights = F.transform("weights", lambda w: F.struct(w["idf"].alias("idf"), w["token"].alias("token")))
    bm25 = F.aggregate(F.coalesce(weights, F.expr("cast(array() as array<struct<idf:double,token:string>>)")),
                       F.lit(0.0), lambda a, w: a + let(
        F.size(F.filter("s_tokens", lambda t: t == w["token"])), lambda tf: w["idf"] * _saturation(tf, dl, avgdl)))
    return (F.when(F.col("q_lower") == F.col("term_lower"), BOOST_EXACT).otherwise(0.0)
            + F.when(_phrase(), BOOST_PHRASE).otherwise(0.0) + bm25)


def _phrase() -> Column:
    """Whether the term's tokens stand in the synonym one after the other."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return (F.size("q_tokens") > 0) & pad(F.col("s_tokens")).contains(pad(F.col("q_tokens")))


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("term").orderBy(F.desc(F.round("score", 9)), F.desc("is_preferred"), "ord", "cui")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_match(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Best match of each term at any score; the first tier sets the bar for all other tokens."""
    return lookup_terms(terms, synonyms, 1)


def top_concepts(terms: DataFrame, synonyms: DataFrame, min_score: float = rules.MIN_LOOKUP_SCORE) -> DataFrame:
    """Best match of each term above ``min_score``: term, cui, syn_term, score, semantic_types."""
    return lookup_terms(terms, synonyms, 1, min_score).drop("rank")


def get_concept(cuis: DataFrame, concepts: DataFrame) -> DataFrame:
    return cuis.select("cui").distinct().join(concepts, "cui", "left")


def canonical_of(terms: DataFrame, synonyms: DataFrame, concepts: DataFrame,
                 min_score: float = rules.MIN_LOOKUP_SCORE) -> DataFrame:
    """term -> preferred term of its best concept, null below the threshold."""
    best = top_concepts(terms, synonyms, min_score).join(concepts.select("cui", "preferred_term"), "cui")
    return terms.select("term").distinct().join(best.select("term", "cui", "preferred_term"), "term", "left")


def synonyms_of(terms: DataFrame, synonyms: DataFrame, concepts: DataFrame) -> DataFrame:
    """term -> sorted normalised terms of its top concept (no threshold)."""
    best = top_match(terms, synonyms).select("term", "cui")
    return best.join(concepts.select("cui", "terms"), "cui").select(
        "term", "cui", F.array_sort(F.array_distinct(F.transform("terms", norm_term))).alias("synonyms"))


def expand_with_synonyms(words: DataFrame, syn: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Each word plus its synonyms (``syn``: term, synonyms; words without an entry use the fixed groups)."""
    j = words.join(syn.select(F.col("term").alias("word"), "synonyms"), "word", "left")
    both = F.array_union(F.array("word"), F.coalesce("synonyms", fallback_group(F.col("word")),
                                                      F.expr("cast(array() as array<string>)")))
    return j.select(*keys, F.explode(both).alias("expanded")).distinct()


def are_synonyms(pairs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds ``are_synonyms``: equal after normalisation, same top concept, or same fixed group."""
    terms = pairs.select(F.col("term1").alias("term")).union(pairs.select("term2"))
    top = top_match(terms, synonyms).select("term", "cui")
    j = pairs.join(top.select(F.col("term").alias("term1"), F.col("cui").alias("_c1")), "term1", "left").join(
        top.select(F.col("term").alias("term2"), F.col("cui").alias("_c2")), "term2", "left")
    n1, n2 = F.trim(F.lower("term1")), F.trim(F.lower("term2"))
    same = ((norm_term(F.col("term1")) == norm_term(F.col("term2"))) | F.coalesce(F.col("_c1") == F.col("_c2"), F.lit(False))
            | F.coalesce(F.array_contains(fallback_group(n1), n2), F.lit(False)))
    return j.withColumn("are_synonyms", same).select(*pairs.columns, "are_synonyms")


def semantic_types_of(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    return top_match(terms, synonyms).select("term", "cui", "semantic_types")


def _fallback_map(value) -> Column:
    pairs = [(t, value(g)) for g in rules.FALLBACK_SYNONYMS for t in g]
    return F.create_map(*[x for t, v in pairs for x in (F.lit(t), v)])


def fallback_canonical(term: Column) -> Column:
    """Shortest member of the term's fixed group, or null."""
    return F.try_element_at(_fallback_map(lambda g: F.lit(min(g, key=len))), F.trim(F.lower(term)))


def fallback_group(term: Column) -> Column:
    return F.try_element_at(_fallback_map(literal_words), F.trim(F.lower(term)))


# ------------------------------------------------------------ text <-> phrases


def ngrams(words: Column, max_n) -> Column:
    """Distinct phrases of 1..max_n consecutive words."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w, i: F.transform(
        F.sequence(F.lit(1), F.least(max_n if isinstance(max_n, Column) else F.lit(max_n), F.size(words) - i)),
        lambda n: F.array_join(F.slice(words, i + 1, n), " ")))))


#: Most bits of a table of phrases; more phrases than half of them are joined without it.
MOST_BITS = 1 << 22


def phrase_bits(dictionary: DataFrame, most: int = MOST_BITS):
    """Column -> Column: whether a phrase can be one of ``dictionary`` (stored); None if there are too many.

    A bit table of 16 bits a phrase, built by aggregation: the driver gets its words only, ``most`` / 64 numbers at
    most. It says yes to each phrase of the dictionary, and to about one in 16 of all others.
    """
    n = dictionary.count()
    if n > most // 2:
        return None
    bits = min(most, max(1 << 12, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marked = dictionary.select(place(F.col("phrase")).alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("marks"))
    words = [0] * (bits // 64)
    for r in marked.collect():
        words[r.word] = r.marks
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
    return lambda c: F.getbit(F.get(table, F.shiftrightunsigned(place(c), 6).cast("int")), place(c).bitwiseAND(F.lit(63)).cast("int")) == 1


def phrase_hits(df: DataFrame, words: Column, dictionary: DataFrame, max_n: int, keys=("doc_id",)) -> DataFrame:
    """(keys, ``_hits``): phrases of ``dictionary(phrase, value)`` in each row's words, left to right, longest first.

    Hits are (pos, neg, n, phrase, value) in text order and do not overlap; rows
    without any are absent. A phrase leaves its row only if a bit table of the
    dictionary has it (``phrase_bits``), and only keys, places and phrases travel,
    never the text; longer ones are made only behind a word that begins some phrase. The dictionary is stored, so both sides of the join are plain
    exchanges and a phrase that a large part of the corpus holds is split over
    tasks. What is gathered per row is bounded by the row's own text.
    """
    dictionary = cut(dictionary)
    known = phrase_bits(dictionary)
    begins = phrase_bits(dictionary.select(F.element_at(F.split("phrase", " "), 1).alias("phrase")).distinct())
    any_ = lambda c: F.lit(True)
    none = F.expr("cast(array() as array<struct<pos:int,n:int,phrase:string>>)")

    def at(w: Column, i: Column) -> Column:
        here = F.transform(F.sequence(F.lit(1), F.least(F.lit(max_n), F.size(words) - i)), lambda n: F.struct(
            (i + 1).alias("pos"), n.alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase")))
        return F.when((begins or any_)(w), F.filter(here, lambda p: known(p["phrase"])) if known else here).otherwise(none)

    places = F.flatten(F.transform(words, at))
    found = df.select(*keys, F.inline(once(places))).join(dictionary, "phrase")
    hits = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "pos", (-F.col("n")).alias("neg"), "n", "phrase", "value"))).alias("_hits"))
    none = F.slice("_hits", 1, 0)
    walked = F.aggregate("_hits", F.struct(F.lit(1).alias("next"), none.alias("out")), lambda acc, h: F.when(
        h["pos"] < acc["next"], acc).otherwise(F.struct(
            (h["pos"] + h["n"]).alias("next"), F.concat(acc["out"], F.array(h)).alias("out"))), lambda acc: acc["out"])
    return hits.withColumn("_hits", walked)


def replace_hits(words: Column, hits: Column) -> Column:
    """Words with each hit's words replaced by its value; ``hits`` as ``phrase_hits`` gives them."""
    def behind(i: Column) -> Column:
        last = F.get(hits, i - 1)
        return F.coalesce(last["pos"] + last["n"], F.lit(1))

    parts = F.transform(hits, lambda h, i: F.concat(F.slice(words, behind(i), h["pos"] - behind(i)), F.array(h["value"])))
    end = behind(F.size(hits))
    return F.concat(F.flatten(parts), F.slice(words, end, F.greatest(F.size(words) - end + 1, F.lit(0))))


def greedy_replace(words: Column, table: Column, max_n: int, lower: bool = False) -> Column:
    """Left to right, longest phrase first, replace phrases found in ``table``.

    ``table`` is a map phrase -> replacement; a fold over word positions whose
    state is (next free position, output).
    """
    def look(n: int, i: Column) -> Column:
        phrase = F.array_join(F.slice(words, i, n), " ")
        hit = F.try_element_at(table, F.lower(phrase) if lower else phrase)
        return F.when(i + n - 1 <= F.size(words), F.struct(F.lit(n).alias("n"), hit.alias("v")))

    def best(i: Column) -> Column:
        options = F.filter(F.array(*[look(n, i) for n in range(max_n, 0, -1)]),
                           lambda o: o["v"].isNotNull())
        return F.coalesce(F.try_element_at(options, F.lit(1)),
                          F.struct(F.lit(1).alias("n"), F.element_at(words, i).alias("v")))

    folded = F.aggregate(
        F.sequence(F.lit(1), F.size(words)),
        F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, i: F.when(i < acc["next"], acc).otherwise(let(best(i), lambda o: F.struct(
            (i + o["n"]).alias("next"), F.concat(acc["out"], F.array(o["v"])).alias("out")))),
        lambda acc: acc["out"])
    return F.when(F.size(words) == 0, F.expr("cast(array() as array<string>)")).otherwise(folded)


def fallback_canonicalize(c: Column) -> Column:
    """Replace phrases of the fixed synonym groups by their canonical form."""
    known = "|".join(sorted((t for g in rules.FALLBACK_SYNONYMS for t in g), key=len, reverse=True))
    table = _fallback_map(lambda g: F.lit(min(g, key=len)))
    plain = F.array_join(words_ws(c), " ")
    return F.when(has(c, rf"(?:{known.replace(' ', chr(92) + 's+')})", "i"), let(
        words_ws(c), lambda w: F.array_join(greedy_replace(w, table, 4, lower=True), " "))).otherwise(plain)


def canonicalize(df: DataFrame, text: str, canonical: DataFrame, *, max_n: int = 3,
                 keys=("doc_id",), out: str = "canonical_text") -> DataFrame:
    """Terminology pass (``canonical``: phrase, value; up to 3 words), then the fixed groups (4 words)."""
    w = df.withColumn("_w", words_ws(F.col(text)))
    m = w.join(phrase_hits(df, words_ws(F.col(text)), canonical, max_n, keys), list(keys), "left")
    first = F.when(F.col("_hits").isNull(), F.col("_w")).otherwise(replace_hits(F.col("_w"), F.col("_hits")))
    staged = m.withColumn("_t", F.array_join(first, " "))
    return staged.withColumn(out, fallback_canonicalize(F.col("_t"))).drop("_w", "_hits", "_t")


def match_concepts(df: DataFrame, text: str, synonyms: DataFrame, *, max_n: int = 4, keys=("doc_id",),
                   entity_labels: DataFrame | None = None, out: str = "concepts") -> DataFrame:
    """Adds ``out``: ``array<struct<cui,tuis>>`` of concepts mentioned, longest phrase first.

    Gazetteer form: word n-grams joined by equality to ``term_lower``; one
    concept per string (preferred first, then ord).  Phrases whose label in
    ``entity_labels(phrase, label)`` is an organisation, place, person or
    product are left out.
    """
    return mentions(df, text, synonyms, max_n=max_n, keys=keys, entity_labels=entity_labels).select(
        *df.columns, F.array_sort(F.array_distinct(F.transform("_mentions", lambda m: F.struct(
            m["cui"].alias("cui"), m["tuis"].alias("tuis"))))).alias(out))


MENTIONS = "array<struct<pos:int,phrase:string,cui:string,tuis:array<string>>>"


def mention_table(df: DataFrame, text: str, synonyms: DataFrame, *, max_n: int = 4, keys=("doc_id",),
                  entity_labels: DataFrame | None = None) -> DataFrame:
    """(keys, ``_mentions``) of the rows that mention something: the matched phrases in text order with cui and TUIs.

    The text stays where it is; join the result only where both are needed.
    """
    one = synonyms.groupBy("term_lower").agg(F.min_by(
        F.struct("cui", F.col("semantic_types").alias("tuis")),
        F.struct((~F.col("is_preferred")).alias("np"), "ord", "cui")).alias("value"))
    dictionary = one.select(F.col("term_lower").alias("phrase"), "value")
    if entity_labels is not None:
        bad = entity_labels.filter(F.upper("label").isin(rules.SKIPPED_ENTITY_LABELS)).select(
            F.lower("phrase").alias("phrase")).distinct()
        dictionary = dictionary.join(bad, "phrase", "left_anti")
    words = find_all(F.lower(F.coalesce(text, F.lit(""))), r"[\w']+(?:-[\w']+)*")
    hits = phrase_hits(df.select(*keys, words.alias("_w")), F.col("_w"), dictionary, max_n, keys)
    return hits.select(*keys, F.transform("_hits", lambda h: F.struct(
        h["pos"].alias("pos"), h["phrase"].alias("phrase"), h["value"]["cui"].alias("cui"),
        h["value"]["tuis"].alias("tuis"))).alias("_mentions"))


def mentions(df: DataFrame, text: str, synonyms: DataFrame, *, max_n: int = 4, keys=("doc_id",),
             entity_labels: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_mentions`` (``mention_table``), empty where nothing is mentioned."""
    found = mention_table(df, text, synonyms, max_n=max_n, keys=keys, entity_labels=entity_labels)
    return df.join(found, list(keys), "left").withColumn(
        "_mentions", F.coalesce("_mentions", F.expr(f"cast(array() as {MENTIONS})")))


def is_medical_term(mentioned: Column) -> Column:
    return F.size(mentioned) > 0


def entity_type(mentioned: Column, label_of) -> Column:
    """Label of the first mention; ``label_of`` maps its TUIs to a label."""
    first = F.try_element_at(mentioned, F.lit(1))
    return F.when(first.isNotNull(), extract.map_entity_label(label_of(first["tuis"])))


def rank_concepts(text: Column, mentioned: Column) -> Column:
    """``array<struct<importance,text,cui>>``: critical patterns, then high, then normal; all of them.

    A phrase already reported is not repeated.  Critical matches are sorted.
    """
    high_types = literal_words(rules.IMPORTANT_TYPES)
    crit = F.array_sort(extract.extract_critical(F.coalesce(text, F.lit(""))))

    def build(x: Column) -> Column:
        uniq = F.filter(x["c"], lambda m, i: F.array_position(x["low"], F.lower(m)) == i + 1)
        rest = F.filter(mentioned, lambda m, i: ~F.array_contains(x["low"], F.lower(m["phrase"]))
                        & (F.array_position(x["said"], m["phrase"]) == i + 1))
        high = F.filter(rest, lambda m: F.arrays_overlap(m["tuis"], high_types))
        norm = F.filter(rest, lambda m: ~F.coalesce(F.arrays_overlap(m["tuis"], high_types), F.lit(False)))

        def item(name: str, get, cui):
            return lambda m: F.struct(F.lit(name).alias("importance"), get(m).alias("text"), cui(m).alias("cui"))
        null = lambda m: F.lit(None).cast("string")
        return F.concat(F.transform(uniq, item("critical", lambda m: m, null)),
                        F.transform(high, item("high", lambda m: m["phrase"], lambda m: m["cui"])),
                        F.transform(norm, item("normal", lambda m: m["phrase"], lambda m: m["cui"])))

    return let(crit, lambda c: let(F.struct(c.alias("c"), F.transform(c, F.lower).alias("low"),
                                            F.transform(mentioned, lambda z: z["phrase"]).alias("said")), build))


def _of(ranked: Column, importance: str) -> Column:
    return F.filter(ranked, lambda c: c["importance"] == importance)


def format_concepts(ranked: Column, caps: dict[str, int] | None = rules.CONCEPT_CAPS,
                    header: str = "Concepts to keep:") -> Column:
    """Prompt block listing the first ``caps`` concepts of each importance (None: all); empty when there are none."""
    if caps is not None:
        ranked = F.concat(*[F.slice(_of(ranked, k), 1, n) for k, n in caps.items()])
    line = lambda c: F.when(c["importance"] == "critical", F.concat(F.lit("  * "), c["text"], F.lit(" [MUST INCLUDE]")))\
        .when(c["importance"] == "high", F.concat(F.lit("  * "), c["text"])).otherwise(F.concat(F.lit("  - "), c["text"]))
    return let(ranked, lambda r: F.when(F.size(r) == 0, F.lit("")).otherwise(F.concat(
        F.lit(header + "\n"), F.array_join(F.transform(r, line), "\n"))))


def table_counts(sizes: bool = False, **tables: DataFrame) -> DataFrame:
    """Row count per named table; with ``sizes`` also ``bytes``, the size that the planner knows (of files: their own)."""
    def one(name: str, t: DataFrame) -> DataFrame:
        out = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        if not sizes:
            return out
        known = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return out.withColumn("bytes", F.lit(known))

    return reduce(DataFrame.unionByName, [one(n, t) for n, t in tables.items()])

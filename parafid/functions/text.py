"""Normalisation, segmentation and simple projections (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rx import WS, ascii_jrx, collapse, is_ascii, jrx, literal_words, strip


def clean_text(c: Column) -> Column:
    return collapse(c)


def _kept(parts: Column, min_len: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > min_len)


def sentences_lookbehind(c: Column) -> Column:
    """Split after ``.!?`` plus white space; keep trimmed pieces longer than 10."""
    return _kept(F.split(c, rf"(?<=[.!?])[{WS}]+"), 10)


def sentences_terminator(c: Column) -> Column:
    return _kept(F.split(c, r"[.!?]+"), 0)


def sentences_expanded(c: Column) -> Column:
    """Sentence split followed by a bullet/newline split; keep longer than 10."""
    first = F.split(c, rf"(?<=[.!?])[{WS}]+")
    return _kept(F.flatten(F.transform(first, lambda s: F.when(
        s.contains("\n") | s.contains("•") | s.contains("*"), F.split(s, r"[\n•*]+")).otherwise(F.array(s)))), 10)


def words_apostrophe(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[a-zA-Z]+(?:'[a-zA-Z]+)?"), F.lit(0))


def words_bounded(c: Column) -> Column:
    r"""``\b[a-zA-Z]+\b`` with Unicode boundaries."""
    word = r"\b[a-zA-Z]+\b"
    return F.regexp_extract_all(c, F.when(is_ascii(c), F.lit(ascii_jrx(word))).otherwise(F.lit(jrx(word))), F.lit(0))


def words_ws(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), F.lit(0))  # split would compile its pattern for every row


def word_count_ws(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{WS}]+"))


def norm_term(c: Column) -> Column:
    return collapse(F.lower(c))


def norm_ws_lower(c: Column) -> Column:
    return F.lower(collapse(c))


def norm_alnum(c: Column) -> Column:
    """Lower, collapse, then drop everything but word characters, spaces, hyphens."""
    return F.regexp_replace(collapse(F.lower(c)), jrx(r"[^\w\s\-]"), "")


def norm_nospace(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"[{WS}]+", "")


def number_words_to_digits(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.NUMBER_WORDS.items() for x in kv])
    return F.array_join(
        F.transform(words_ws(F.lower(c)), lambda w: F.when(
            w.isin(list(rules.NUMBER_WORDS)), F.try_element_at(table, w)).otherwise(w)), " ")


def sanitize_keyword(c: Column) -> Column:
    return collapse(F.regexp_replace(c, rules.KEYWORD_METACHARS, ""))


def truncate(c: Column, n: int = rules.PREVIEW_CHARS) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


preview = truncate


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.concat(F.lit("source-"), F.regexp_replace(dashed, r"^-|-\z", ""))


def content_density(c: Column) -> Column:
    """Share of alphanumeric characters; 0 for empty text."""
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.coalesce(F.try_divide(alnum, F.length(c)), F.lit(0.0))


def syllables(word: Column, consonant_le: bool) -> Column:
    """Vowel groups minus a silent final e, at least 1; words up to 3 letters count 1.

    ``consonant_le`` adds the rule that a final consonant + "le" is a syllable.
    """
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    plain = F.greatest(F.lit(1), groups - w.endswith("e").cast("int"))
    if consonant_le:
        plain = F.when(w.rlike(r"[^aeiouy]le\z"), F.greatest(F.lit(2), groups)).otherwise(plain)
    return F.when(F.length(w) <= 3, 1).otherwise(plain)

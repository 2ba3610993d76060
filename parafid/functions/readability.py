"""Readability formulas (Column -> struct)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import count_medical_terms, jargon_density
from .rx import let
from .sets import exact_round, ratio
from .text import sentences_terminator, words_apostrophe, words_bounded


def _counts(words: Column, sentences: Column, consonant_le: bool) -> Column:
    """struct(w, s, syl, hard): words, sentences, syllables, words of 3+ syllables.

    ``syllables`` of all words, counted by a few patterns over the long ones in a row instead of word by word; a word is
    of ASCII letters (and one apostrophe), so plain classes do.
    """
    vowel, other = "[aeiouy]", "[^aeiouy ]"
    word = lambda p: F.lit(f"(?<= )(?:{p})(?= )")

    def count(x: Column) -> Column:
        row = x["row"]
        two = f"(?:{other}*+{vowel}++){{2}}"
        syl = (F.size(x["words"]) - x["n"] + F.regexp_count(row, F.lit(f"{vowel}+")) - F.regexp_count(row, F.lit("e "))
               + F.regexp_count(row, word(f"{other}++|{other}*+{vowel}*e")))  # no word has less than one
        hard = F.regexp_count(row, word(rf"{two}{other}++{vowel}[^ ]*+")) - F.regexp_count(row, word(f"{two}{other}++{vowel}*e"))
        if consonant_le:
            syl = syl + F.regexp_count(row, F.lit(f"{other}le "))
            hard = hard + F.regexp_count(row, word(f"{two}{other}+le"))
        none = x["n"] == 0
        return F.struct(F.size(x["words"]).alias("w"), F.size(sentences).alias("s"),
                        F.when(none, F.size(x["words"])).otherwise(syl).alias("syl"), F.when(none, 0).otherwise(hard).alias("hard"))

    def long(ws: Column) -> Column:
        return let(F.filter(ws, lambda w: F.length(w) > 3), lambda ls: F.struct(
            ws.alias("words"), F.size(ls).alias("n"), F.concat(F.lit(" "), F.lower(F.array_join(ls, " ")), F.lit(" ")).alias("row")))
    return let(let(words, long), count)


def _fkgl(n: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.39 * (n["w"] / n["s"]) + 11.8 * (n["syl"] / n["w"]) - 15.59)


def readability(c: Column, cui_count: Column | None = None) -> Column:
    """Grade level, SMOG, sentence length and jargon share of one text.

    ``cui_count`` replaces the pattern heuristic when concepts were matched.
    """
    def build(n: Column) -> Column:
        both = (n["w"] > 0) & (n["s"] > 0)
        scale = F.when(n["s"] < 30, 30 / n["s"]).otherwise(F.lit(1.0))
        terms = cui_count if cui_count is not None else count_medical_terms(c)
        return let(terms, lambda t: F.struct(
            exact_round(F.when(both, _fkgl(n)).otherwise(F.lit(0.0)), 2).alias("fkgl"),
            exact_round(F.when(n["s"] > 0, 1.043 * F.sqrt(n["hard"] * scale) + 3.1291).otherwise(F.lit(0.0)), 2)
            .alias("smog"),
            exact_round(ratio(n["w"], F.nullif(n["s"], F.lit(0)), 0.0), 2).alias("avg_sentence_length"),
            exact_round(ratio(t, F.nullif(n["w"], F.lit(0)), 0.0), 4).alias("jargon_density"),
            n["w"].alias("total_tokens"), t.alias("cui_count")))
    return let(_counts(words_apostrophe(c), sentences_terminator(c), True), build)


def simple_readability(c: Column) -> Column:
    """The before/after variant: other tokeniser, other syllable and SMOG rules."""
    def build(x: Column) -> Column:
        return let(_counts(x["words"], x["sents"], False), lambda n: finish(n, jargon_density(x["words"])))

    def finish(n: Column, jargon: Column) -> Column:
        ok = (n["w"] > 0) & (n["s"] > 0)
        smog = F.when(n["s"] >= 3, 1.043 * F.sqrt(n["hard"] * (30 / n["s"])) + 3.1291).otherwise(
            3.0 + F.sqrt(n["hard"]))
        zero = F.lit(0.0)
        return F.struct(
            F.when(ok, exact_round(_fkgl(n), 1)).otherwise(zero).alias("fkgl"),
            F.when(ok, exact_round(smog, 1)).otherwise(zero).alias("smog"),
            F.when(ok, exact_round(n["w"] / n["s"], 1)).otherwise(zero).alias("avg_sentence_length"),
            jargon.alias("jargon_density"), n["w"].alias("word_count"), n["s"].alias("sentence_count"))

    return let(F.struct(words_bounded(c).alias("words"), sentences_terminator(c).alias("sents")), build)


def compare(o: Column, s: Column) -> Column:
    """Before/after comparison out of two ``simple_readability`` structs."""
    return F.struct(
        o["fkgl"].alias("original_fkgl"), o["smog"].alias("original_smog"),
        o["avg_sentence_length"].alias("original_avg_sentence_length"),
        exact_round(o["jargon_density"], 4).alias("original_jargon_density"),
        s["fkgl"].alias("simplified_fkgl"), s["smog"].alias("simplified_smog"),
        s["avg_sentence_length"].alias("simplified_avg_sentence_length"),
        exact_round(s["jargon_density"], 4).alias("simplified_jargon_density"),
        exact_round(s["fkgl"] - o["fkgl"], 1).alias("fkgl_delta"),
        exact_round(s["smog"] - o["smog"], 1).alias("smog_delta"),
        exact_round(s["avg_sentence_length"] - o["avg_sentence_length"], 1).alias("sentence_length_delta"),
        exact_round(o["jargon_density"] - s["jargon_density"], 4).alias("jargon_reduction"))

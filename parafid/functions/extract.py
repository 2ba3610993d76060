"""Pattern extraction: every function returns a per-row array or scalar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rx import MARK, PART, WS, any_of, ascii_any_of, ascii_jrx, between_marks, collapse, contains_any, count_all, expand, find_all, find_if, folded, has, is_ascii, jrx, let, literal_words, needles, required, spans, spans_of_any, strip, tests
from .text import norm_nospace, sanitize_keyword, words_bounded, words_ws

NUMBER_TYPE = "array<struct<value:double,text:string,unit:string,context:string>>"


def _unit_pattern(unit_mode: str) -> str:
    units = {"first": rules.UNITS_FIRST, "longest": rules.UNITS_LONGEST}[unit_mode]
    return rf"({rules.NUMBER})\s*({units})?"


def _window(c: Column, start: Column, end: Column, width: int) -> Column:
    left = F.greatest(F.lit(0), start - width)
    return F.substring(c, left + 1, end + width - left)


def extract_numbers(c: Column, unit_mode: str = "first") -> Column:
    """Numbers with optional unit and their +-30 character context."""
    pat = _unit_pattern(unit_mode)
    head = jrx(rf"^({rules.NUMBER})")
    tail = jrx(rf"^{rules.NUMBER}\s*")

    def number(text: Column, unit: Column, start: Column, end: Column) -> Column:
        return F.struct(text.try_cast("double").alias("value"), text.alias("text"),
                        F.nullif(F.lower(unit), F.lit("")).alias("unit"), _window(c, start, end, rules.CONTEXT_CHARS).alias("context"))

    # number, gap and unit are told apart by marks within the match
    marked = F.regexp_replace(c, jrx(pat.replace(r"\s*", r"(\s*)", 1), "i"), f"{MARK}$1{PART}$2{PART}$3{MARK}")
    cut = between_marks(marked, 4, lambda m, start: number(
        F.substring_index(m, PART, 1), F.substring_index(m, PART, -1), start, start + F.length(m) - 2))
    plain = F.transform(spans(c, pat, "i"), lambda m: number(
        F.regexp_extract(m["text"], head, 1), F.regexp_replace(m["text"], tail, ""), m["start"], m["end"]))
    return F.when(c.contains(MARK) | c.contains(PART) | c.isNull(), plain).when(is_ascii(c), _ascii_numbers(c, pat)).otherwise(cut)


def _ascii_numbers(c: Column, pat: str) -> Column:
    """``extract_numbers`` of a text of ASCII characters without marks: each match is written out with its context in one pass."""
    n = rules.CONTEXT_CHARS
    before = rf"(?:(?<=((?s:.){{{n}}}))|(?<=\A((?s:.){{0,{n - 1}}})))"
    match = before + pat.replace(r"\s*", r"(\s*)", 1) + rf"(?=((?s:.){{0,{n}}}))"
    regex = ascii_jrx(rf"[^0-9]*+(?:(?=[0-9]){match}|\z)", "i")  # what is behind the last match is consumed too, at once
    listed = F.split(F.regexp_replace(c, regex, f"$1$2$3$4$5$6{PART}$3{PART}$5{MARK}"), MARK, -1)

    def number(m: Column) -> Column:
        return let(F.split(m, PART, -1), lambda x: F.struct(
            x[1].try_cast("double").alias("value"), x[1].alias("text"), F.nullif(F.lower(x[2]), F.lit("")).alias("unit"), x[0].alias("context")))
    return F.transform(F.filter(listed, lambda m: F.length(m) > 2), number)


def number_values(c: Column) -> Column:
    """Just the distinct numeric values (same matches as ``extract_numbers``)."""
    return F.array_distinct(F.transform(find_all(c, rules.NUMBER), lambda x: x.try_cast("double")))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _may_hold_noise(c: Column) -> Column:
    """False only where no piece of the text matches a date or ignore pattern: each match holds one of these."""
    digits = rf"\d(?:\d{{3}}|-\d{{1,2}}-\d|[{WS}]*(?:of|/)[{WS}]*\d|:\d)"
    words = [*MONTHS, "page", "mrn", "#"]
    full = let(folded(c), lambda low: low.rlike(expand(digits)) | contains_any(low, words))
    plain = ascii_jrx(digits) + f"|(?i:(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(words)}))"
    return F.when(is_ascii(c), c.rlike(plain)).otherwise(full)


def drop_ignored_numbers(numbers: Column, text: Column | None = None) -> Column:
    """Drop numbers whose context holds a date, year, phone, id, page or time.

    Contexts are looked at only where ``text``, which they are cut from, can hold such a thing.
    """
    patterns = rules.DATE_PATTERNS + rules.IGNORE_PATTERNS
    quiet = lambda m: ~m["context"].rlike(any_of(patterns))
    quiet_ascii = lambda m: ~m["context"].rlike(ascii_any_of(patterns))
    if text is None:
        return F.filter(numbers, lambda m: F.when(is_ascii(m["context"]), quiet_ascii(m)).otherwise(quiet(m)))
    kept = F.when(is_ascii(text), F.filter(numbers, quiet_ascii)).otherwise(F.filter(numbers, quiet))
    return F.when(_may_hold_noise(text), kept).otherwise(numbers)


def extract_bp(c: Column) -> Column:
    """Blood-pressure readings as two mmhg numbers, unless inside a date or id."""
    none = F.expr(f"cast(array() as {NUMBER_TYPE})")
    pat = jrx(rules.BLOOD_PRESSURE, "i")

    def both(b: Column) -> Column:
        ctx = _window(c, b["start"], b["end"], 20)
        return F.array(*[F.struct(
            F.regexp_extract(b["text"], pat, g).try_cast("double").alias("value"),
            F.regexp_extract(b["text"], pat, g).alias("text"),
            F.lit("mmhg").alias("unit"), ctx.alias("context")) for g in (1, 2)])

    noise = rules.DATE_PATTERNS + rules.IGNORE_PATTERNS
    no_spans = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")

    def uncovered(x: Column) -> Column:
        covered = F.when(x["low"].rlike(any_of(noise)), spans_of_any(x["low"], folded(c), noise)).otherwise(no_spans)
        return let(covered, lambda bad: F.filter(x["found"], lambda b: ~F.exists(
            bad, lambda s: (s["start"] <= b["start"]) & (b["start"] < s["end"]))))

    def readings(x: Column) -> Column:
        kinds = F.transform(x["found"], lambda b: _reading_kind(x["low"], b["start"]))
        kept = F.when(is_ascii(x["low"]), let(kinds, lambda k: F.when(
            F.array_contains(k, 2), uncovered(x)).otherwise(F.filter(x["found"], lambda b, i: F.get(k, i) == 0)))).otherwise(uncovered(x))
        return F.flatten(F.transform(kept, both)).cast(NUMBER_TYPE)

    texts = let(F.lower(c), lambda low: F.struct(low.alias("low"), spans(low, rules.BLOOD_PRESSURE, "i").alias("found")))
    test = F.when(is_ascii(c), c.rlike(ascii_jrx(rules.BLOOD_PRESSURE, "i"))).otherwise(has(c, rules.BLOOD_PRESSURE, "i"))
    return F.when(c.contains("/") & test, let(texts, readings)).otherwise(none)


def _reading_kind(low: Column, start: Column) -> Column:
    """For a blood-pressure match of an ASCII text: 0 if no date or ignore pattern can cover its start, 1 if a date does, else 2.

    0: a word that starts no such pattern and blanks before it, and behind it, on its line, what continues none.
    1: it lies in a date that touches no digit, letter or slash, which the date's pattern therefore finds.
    """
    left = F.greatest(F.lit(0), start - 40)
    return let(F.concat(F.substring(low, left + 1, start - left), F.lit(MARK), F.substring(low, start + 1, F.lit(40))), lambda s: F.when(
        s.rlike(rf"^(?:[^{MARK}]*[^a-z0-9_])?(?!{'|'.join([*MONTHS, 'page', 'mrn'])})[a-z]{{1,20}} {{1,4}}{MARK}[0-9]{{2,3}} ?/ ?[0-9]{{2,3}} {{0,2}}[a-z(,;]"), 0).when(
        s.rlike(rf"^(?:[^{MARK}]*[^a-z0-9_/])?(?:{MARK}[0-9]{{1,2}}/|[0-9]{{1,2}}/{MARK})[0-9]{{1,2}}/[0-9]{{2,4}}(?![a-z0-9_/])"), 1).otherwise(2))


def measurements(c: Column, unit_mode: str = "first") -> Column:
    """Filtered numbers followed by blood-pressure values."""
    numbers = let(extract_numbers(c, unit_mode), lambda n: drop_ignored_numbers(n, c))
    return F.concat(numbers.cast(NUMBER_TYPE), extract_bp(c))


def laterality(c: Column, side: str) -> Column:
    return _side_words(find_all(F.lower(c), rules.LATERALITY_WORD), side)


def _side_words(words: Column, side: str) -> Column:
    wanted = {"left": rules.LATERALITY_LEFT, "right": rules.LATERALITY_RIGHT}[side]
    return F.array_intersect(words, literal_words(wanted))


def sides(c: Column) -> Column:
    """Struct ``l``, ``r``: whether the text names the side; words are cut only where a hyphen or other scripts need it."""
    def both(words: Column) -> Column:
        return F.struct((F.size(_side_words(words, "left")) > 0).alias("l"), (F.size(_side_words(words, "right")) > 0).alias("r"))

    def named(low: Column, side: str) -> Column:
        return ((low.contains(side) & low.rlike(rf"\b{side}\b(?!\.\w)"))
                | (low.contains(f"{side[0]}.") & low.rlike(rf"\b{side[0]}\.(?=\w)")))

    def find(low: Column) -> Column:
        cut = let(find_all(low, rules.LATERALITY_WORD), both)
        plain = (F.length(low) == F.octet_length(low)) & ~low.contains("-")
        return F.when(contains_any(low, some), F.when(plain, F.struct(
            named(low, "left").alias("l"), named(low, "right").alias("r"))).otherwise(cut)).otherwise(
            F.struct(F.lit(False).alias("l"), F.lit(False).alias("r")))

    some = ["left", "right", "l.", "r."]
    return let(F.lower(c), find)


def normalize_unit(u: Column) -> Column:
    low = strip(F.lower(u))
    table = F.create_map(*[F.lit(x) for kv in rules.UNIT_MAP.items() for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(table, low), low), F.lit(""))


def extract_drug_names(c: Column) -> Column:
    return F.when(c.isNotNull(), _pattern_set(c, rules.DRUG_PATTERNS, F.lower))


def _patterns(c: Column, test: Column, patterns, norm, flags: str = "i") -> Column:
    found = [find_if(c, test, p, flags) for p in patterns]
    return F.array_distinct(F.transform(F.concat(*found) if len(found) > 1 else found[0], norm))


def _pattern_set(c: Column, patterns, norm, flags: str = "i") -> Column:
    return let(tests(c), lambda test: _patterns(c, test, patterns, norm, flags))


def extract_critical(c: Column) -> Column:
    return _pattern_set(c, rules.CRITICAL_PATTERNS, strip)


def extract_critical_typed(c: Column, pack=None) -> Column:
    """Map type -> distinct lower-cased, collapsed matches."""
    pack = pack or rules.CRITICAL_TYPED
    return let(tests(c), lambda test: F.create_map(*[x for name, p in pack.items() for x in (
        F.lit(name), _patterns(c, test, [p], lambda m: collapse(F.lower(m))))]))


def extract_quality_group(c: Column, group: str) -> Column:
    return _pattern_set(c, QUALITY_GROUPS[group], lambda m: collapse(F.lower(m)))


def extract_quality_groups(c: Column) -> Column:
    """Struct of all quality groups; the text is prepared once for them."""
    return let(tests(c), lambda test: F.struct(*[
        _patterns(c, test, patterns, lambda m: collapse(F.lower(m))).alias(name) for name, patterns in QUALITY_GROUPS.items()]))


QUALITY_GROUPS = {"diagnosis": rules.DIAGNOSIS_PATTERNS, "medication": rules.MEDICATION_PATTERNS, "measurement": rules.MEASUREMENT_PATTERNS}


def extract_measurement_keys(c: Column) -> Column:
    """White-space-free measurement keys for coverage."""
    return let(F.lower(c), lambda low: _pattern_set(low, rules.COVERAGE_MEASUREMENTS, norm_nospace))


def count_medical_terms(c: Column) -> Column:
    def count(x: Column, pattern: str) -> Column:
        words = required(pattern)
        n = count_all(x["low"], pattern, "i")
        return F.when(contains_any(x["test"], words), n).otherwise(0) if words else n
    both = F.struct(F.lower(c).alias("low"), folded(c).alias("test"))
    return let(both, lambda x: reduce(lambda a, b: a + b, [count(x, p) for p in rules.MEDICAL_TERM_PATTERNS]))


def extract_grounding_terms(c: Column, stop_words=None) -> Column:
    """Long words and disease-like phrases that are not on the stop/allow list."""
    stop = literal_words((stop_words or rules.STOP_WORDS) + rules.CONTEXT_ALLOWLIST)

    def build(low: Column) -> Column:
        words = F.array_except(find_all(low, r"\b[a-zA-Z]{5,}\b"), stop)
        phrases = F.concat(*[F.when(contains_any(low, required(p)), find_all(low, p, group=1)).otherwise(
            F.expr("cast(array() as array<string>)")) for p in rules.GROUNDING_PHRASES])
        return F.array_distinct(F.concat(words, F.filter(phrases, lambda p: ~is_allowed_term(p, stop))))

    return let(F.lower(c), build)


def is_allowed_term(term: Column, stop: Column) -> Column:
    t = strip(F.lower(term))
    return (F.array_contains(stop, t) | (F.length(t) < rules.MIN_TERM_LENGTH)
            | F.forall(words_ws(t), lambda w: F.array_contains(stop, w) | (F.length(w) < 3)))


RISK_WORD = rf"\b(?:{'|'.join(rules.RISK_TERMS)})\b"


def is_risk_term(term: Column) -> Column:
    """Equals, or contains as a whole word, one of the risk terms."""
    return has(strip(F.lower(term)), RISK_WORD)


def risk_terms(terms: Column) -> Column:
    return F.filter(terms, is_risk_term)


def text_risk_terms(c: Column, stop_words=None) -> Column:
    """``risk_terms`` of a text's grounding terms; they are cut only where the text names a risk term."""
    terms = risk_terms(extract_grounding_terms(c, stop_words))
    return F.when(has(F.lower(c), RISK_WORD), terms).otherwise(F.expr("cast(array() as array<string>)"))


def has_risk_type(tuis: Column) -> Column:
    return F.arrays_overlap(tuis, literal_words(rules.RISK_SEMANTIC_TYPES))


def action_sentences(c: Column) -> Column:
    """Advice-like sentences: ``array<struct<rule,pos,category,severity,sentence,phrase>>``.

    A sentence is a '.'-delimited segment; its first matching rule decides, and
    a repeated sentence is reported once.  Ordered by rule, then position.
    """
    segments = F.split(c, r"\.", -1)
    # literals decide per text which rules can match at all; regexes run only for those
    possible = let(F.lower(c), lambda low: F.array(
        *[contains_any(low, needles(p)) for p, _, _ in rules.ACTION_RULES]))

    def rule_no(can: Column, seg: Column) -> Column:
        expr = None
        for i, (p, _, _) in enumerate(rules.ACTION_RULES):
            cond = can[i] & has(seg, p, "i")
            expr = F.when(cond, i + 1) if expr is None else expr.when(cond, i + 1)
        return expr

    def find(x: Column) -> Column:
        ruled = F.filter(F.transform(x["parts"], lambda seg, i: F.struct(
            rule_no(x["can"], seg).alias("rule"), i.alias("pos"), seg.alias("seg"),
            F.when(i < F.size(x["parts"]) - 1, ".").otherwise("").alias("dot"))), lambda s: s["rule"].isNotNull())
        return F.transform(ruled, lambda s: F.struct(
            s["rule"].alias("rule"), s["pos"].alias("pos"),
            strip(F.concat(s["seg"], s["dot"])).alias("sentence"), strip(s["seg"]).alias("phrase")))

    def run(can: Column) -> Column:
        found = let(F.struct(segments.alias("parts"), can.alias("can")), find)
        return F.when(F.array_contains(can, True), full(found)).otherwise(none)

    def full(found: Column) -> Column:
        first = let(found, lambda all_: F.filter(all_, lambda s, i: F.array_position(
            F.transform(all_, lambda z: z["sentence"]), s["sentence"]) == i + 1))
        return F.transform(F.array_sort(first), lambda s: F.struct(
            s["rule"].alias("rule"), s["pos"].alias("pos"), F.element_at(cats, s["rule"]).alias("category"),
            F.element_at(sevs, s["rule"]).alias("severity"), s["sentence"].alias("sentence"),
            s["phrase"].alias("phrase")))

    cats = literal_words([r[1] for r in rules.ACTION_RULES])
    sevs = literal_words([r[2] for r in rules.ACTION_RULES])
    none = F.expr("cast(array() as array<struct<rule:int,pos:int,category:string,severity:string,"
                  "sentence:string,phrase:string>>)")
    return let(possible, run)


def extract_evidence_spans(c: Column) -> Column:
    quoted = [F.transform(find_all(c, p, f, 1), strip) for p, f in rules.EVIDENCE_PATTERNS]
    return F.filter(F.concat(*quoted), lambda s: s != "")


def find_ungrounded_claims(c: Column, evidence: Column) -> Column:
    cue = any_of(rules.CLAIM_PATTERNS, "i")
    sents = F.split(c, expand(r"[.!?]\s+"))
    bare = F.filter(sents, lambda s: s.rlike(cue) & ~F.exists(
        evidence, lambda e: s.contains(e) | e.contains(s)))
    return F.transform(bare, strip)


def extract_plain_numbers(c: Column) -> Column:
    return F.array_distinct(find_all(c, rules.PLAIN_NUMBER))


def extract_negations(c: Column) -> Column:
    return F.array_distinct(find_all(F.lower(c), rules.NEGATION, group=1))


def extract_keyword_entities(c: Column, keywords: Column) -> Column:
    """Sanitised keywords (length >= 2) that occur as whole words, lower-cased."""
    clean = F.filter(F.transform(keywords, lambda k: F.lower(sanitize_keyword(k))),
                     lambda k: F.length(k) >= 2)
    return let(F.lower(c), lambda low: F.array_distinct(F.filter(clean, lambda k: F.regexp_like(
        low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), k, F.lit(r"\E(?![\p{L}\p{N}_])"))))))


def glossary_candidates(c: Column, acronyms_only: bool = False) -> Column:
    """Sorted candidate terms.  By default case is ignored, so every word of two
    or more letters qualifies; a dose contributes only its unit."""
    words = find_all(c, rules.GLOSSARY_WORD, "" if acronyms_only else "i")
    return F.array_sort(F.array_distinct(F.concat(words, find_all(c, rules.GLOSSARY_DOSE, "i", 1))))


def jargon_density(words: Column) -> Column:
    """Share of words longer than 8 letters that are not everyday words."""
    common = literal_words(rules.COMMON_LONG_WORDS)
    long_ = F.filter(words, lambda w: (F.length(w) > 8) & ~F.array_contains(common, F.lower(w)))
    return F.coalesce(F.try_divide(F.size(long_), F.size(words)), F.lit(0.0))


def is_meta_talk(c: Column) -> Column:
    return c.rlike(any_of(rules.META_TALK_PATTERNS, "i"))


def map_entity_label(label: Column) -> Column:
    up = F.upper(label)
    expr = None
    for name, (exact, parts) in rules.ENTITY_LABELS.items():
        cond = up.isin(exact)
        for p in parts:
            cond = cond | up.contains(p)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(up)

"""Regex helpers: one spelling of each pattern, adapted to the JVM engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space (as str.isspace sees it) and word characters (letters,
# numbers, underscore), spelled out so that no engine default can change them.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# The characters of WS one by one, for trimming.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
# Marks around the matches of a text that holds neither of them.
MARK, PART = "\x01", "\x02"


def expand(pattern: str) -> str:
    r"""Replace ``\w \s \d`` by explicit Unicode classes."""
    out, inside, i = [], False, 0
    classes = {"w": WORD, "s": WS, "d": DIGIT}
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in classes:
                out.append(classes[nxt] if inside else f"[{classes[nxt]}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not inside:
            inside = True
        elif ch == "]" and inside:
            inside = False
        out.append(ch)
        i += 1
    return "".join(out)


def _alternatives(body: str) -> list[str] | None:
    """Top-level alternatives of the group that starts ``body``, or None if unclosed."""
    out, cur, depth, inside, i = [], "", 0, False, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            cur += body[i:i + 2]
            i += 2
            continue
        if inside:
            inside = ch != "]"
        elif ch == "[":
            inside = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            if depth == 0:
                return [*out, cur]
            depth -= 1
        elif ch == "|" and depth == 0:
            out.append(cur)
            cur = ""
            i += 1
            continue
        cur += ch
        i += 1
    return None


def _first(pattern: str) -> str | None:
    """Character-class body every match must start with, when it is evident."""
    if not pattern:
        return None
    whole = _alternatives(pattern + ")")
    if whole is None:
        return None
    if len(whole) > 1:
        firsts = [_first(x) for x in whole]
        return None if None in firsts else "".join(firsts)
    p = pattern[2:] if pattern.startswith(r"\b") else pattern
    if p.startswith(r"\d") and p[2:3] not in ("*", "?"):
        return DIGIT
    for opener in ("(?:", "("):
        if p.startswith(opener) and not (opener == "(" and p.startswith("(?")):
            rest = p[len(opener):]
            parts = _alternatives(rest)
            if parts is None or rest[sum(map(len, parts)) + len(parts):][:1] in ("*", "?", "{"):
                return None
            firsts = [_first(x) for x in parts]
            return None if None in firsts else "".join(firsts)
    if p.startswith("[") and not p.startswith("[^") and "\\" not in p[:p.find("]")]:
        end = p.find("]")
        return None if p[end + 1:end + 2] in ("*", "?") else p[1:end]
    if p[:1].isalnum() or p[:1] in "#>":
        return None if p[1:2] in ("*", "?", "{") or "|" in p.split("(")[0] else p[0]
    return None


def needles(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match contains at least one, if evident.

    A byte search for them is far cheaper than the pattern itself.
    """
    p = pattern[2:] if pattern.startswith(r"\b") else pattern
    parts = _alternatives(p[p.index("(") + 1:]) if p.startswith("(") and not p.startswith("(?") else [p]
    out = []
    for part in parts or []:
        lit = ""
        for i, ch in enumerate(part):
            if not (ch.isalnum() or ch == " ") or part[i + 1:i + 2] in ("?", "*", "{"):
                break
            lit += ch
        out.append(lit.lower())
    return None if not out or "" in out else out


def _items(pattern: str) -> list[tuple[str, str, bool]] | None:
    """Top-level items of a pattern without alternatives: (kind, text, required)."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            kind, text, i = ("literal", pattern[i + 1], i + 2) if not pattern[i + 1].isalnum() else ("class", "", i + 2)
        elif ch == "[":
            i = pattern.index("]", i + 2) + 1
            kind, text = "class", ""
        elif ch == "(":
            body = i + (3 if pattern[i:i + 3] == "(?:" else 1)
            if pattern[body - 1] == "(" and pattern[body:body + 1] == "?":
                return None
            parts = _alternatives(pattern[body:])
            if parts is None:
                return None
            text = pattern[body:body + sum(map(len, parts)) + len(parts) - 1]
            kind, i = "group", body + len(text) + 1
        elif ch == "|":
            return None
        elif ch in "^$.":
            kind, text, i = "class", "", i + 1
        else:
            kind, text, i = "literal", ch, i + 1
        quantifier = pattern[i:i + 1]
        if quantifier == "{":
            i = pattern.index("}", i) + 1
            kind, text = "class", ""
        elif quantifier in ("?", "*", "+") and quantifier:
            i += 1 + (pattern[i + 1:i + 2] == "?")
        out.append((kind, text, quantifier not in ("?", "*", "{") or not quantifier))
    return out


def required(pattern: str) -> list[str] | None:
    """Lower-case ASCII literals of which every match contains at least one: those that are found least often.

    Found anywhere in the pattern; None when nothing is evident.
    """
    items = _items(pattern)
    if items is None:
        return None
    sets, run = [], ""
    for kind, text, need in [*items, ("class", "", True)]:
        if kind == "literal" and need:
            run += text
            continue
        if run.strip():
            sets.append([run])
        run = ""
        if kind == "group" and need:
            parts = [required(x) for x in _alternatives(text + ")") or []]
            if parts and None not in parts:
                sets.append([x for part in parts for x in part])
    sets = [x for x in sets if all(w.isascii() and w.strip() for w in x)]
    best = max(sets, key=lambda ws: min(map(len, ws)), default=None)
    return None if best is None else sorted({w.lower() for w in best})


def folded(c: Column) -> Column:
    """Text for literal tests that stand before case-insensitive patterns; the three letters fold onto ASCII there."""
    low = F.replace(F.lower(c), F.lit("\u017f"), F.lit("s"))  # cheaper than a translation where none occurs
    full = F.replace(F.replace(low, F.lit("\u0131"), F.lit("i")), F.lit("i\u0307"), F.lit("i"))
    return F.when(is_ascii(c), F.lower(c)).otherwise(full)


def contains_any(low: Column, words: list[str]) -> Column:
    cond = low.contains(words[0])
    for w in words[1:]:
        cond = cond | low.contains(w)
    return cond


def jrx(pattern: str, flags: str = "") -> str:
    """Java form: Unicode word boundaries always on; ``m`` uses plain newlines."""
    extra = "".join(f for f in flags if f in "ism") + ("d" if "m" in flags else "")
    return f"(?U{extra}){_ahead(pattern)}{expand(pattern)}"


def ascii_jrx(pattern: str, flags: str = "") -> str:
    """``jrx`` for texts of ASCII characters alone: the same matches there, by classes that are tested much faster."""
    extra = "".join(f for f in flags if f in "ism") + ("d" if "m" in flags else "")
    return _in_ascii(f"(?{extra}){_ahead(pattern)}{expand(pattern)}" if extra else f"{_ahead(pattern)}{expand(pattern)}")


def _in_ascii(regex: str) -> str:
    return regex.replace(WS, r"\t-\r\x1c-\x20").replace(WORD, "a-zA-Z0-9_").replace(f"[{DIGIT}]", "[0-9]").replace(DIGIT, "0-9")


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def ascii_any_of(patterns) -> str:
    """One test for texts of ASCII characters: whether any (pattern, flags) matches.

    Patterns are grouped by what they start with, so most positions are dismissed by one test of their character, and
    places inside a run of digits by one test of the boundary.
    """
    groups: dict[tuple[str, bool], list[str]] = {}
    for text, flags in patterns:
        first = _in_ascii(_first(text) or "")
        kind = "" if not first else "0-9" if not first.replace("0-9", "").strip("0123456789") else "a-z"
        bound = text.startswith(r"\b")
        extra = "".join(f for f in flags if f in "ism") + ("d" if "m" in flags else "")
        groups.setdefault((kind, bound), []).append((f"(?{extra}:{_in_ascii(expand(text[2 * bound:]))})", first))

    def body(kind: str) -> list[str]:
        return [(r"\b" if bound else "") + "(?:" + "|".join(b for b, _ in bodies) + ")"
                for (k, bound), bodies in sorted(groups.items(), reverse=True) if k == kind]

    def ahead(kind: str) -> str:
        letters = "".join(sorted({x for (k, _), bodies in groups.items() if k == kind for _, f in bodies for x in f}))
        return "(?=[0-9])" if kind == "0-9" else f"(?i:(?=[{letters}]))" if kind else ""
    return "|".join(f"{ahead(k)}(?:{'|'.join(body(k))})" for k in ("0-9", "a-z", "") if body(k))


def _ahead(pattern: str) -> str:
    r"""A look-ahead for the characters that a match starts with: most positions fail it before the costly Unicode ``\b``."""
    first = _first(pattern) if "{0" not in pattern and (pattern.startswith((r"\b", r"\d", r"(\d"))) else None
    return f"(?=[{first}])" if first else ""


def any_of(patterns, flags: str = "") -> str:
    """One alternation out of patterns, each keeping its own flags.

    Patterns that can only start with a digit share one look-ahead, so most
    positions are dismissed by a single test.
    """
    digits, rest = [], []
    for p in patterns:
        text, fl = p if isinstance(p, tuple) else (p, flags)
        first = _first(text)
        group = digits if first and not first.replace(DIGIT, "").strip("0123456789") else rest
        group.append(f"(?:{jrx(text, fl)})")
    parts = rest if not digits else [f"(?={DIGIT})(?:{'|'.join(digits)})", *rest]
    return "|".join(parts)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def once(arr: Column) -> Column:
    """Array for a generator, computed once per row.

    Exploding a plain column makes the optimizer infer a non-empty filter on it,
    which is pushed down and computes an expensive column several times; a full
    slice is the same array but no plain column.
    """
    return F.slice(arr, F.lit(1), F.lit(1 << 30))


def find_all(col: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(jrx(pattern, flags)), F.lit(group))


def find_if(col: Column, test: Column, pattern: str, flags: str = "") -> Column:
    """``find_all``, but only where ``test.low`` (``folded``) has a literal that a match needs; ``test`` is ``tests(col)``."""
    words, low = required(pattern), test["low"]
    regex = F.when(test["plain"], F.lit(ascii_jrx(pattern, flags))).otherwise(F.lit(jrx(pattern, flags)))
    found = F.regexp_extract_all(col, regex, F.lit(0))
    if words and any(len(w) == 1 and w.isalpha() for w in words):
        words = None  # nearly every text has the letter
    return found if not words else F.when(contains_any(low, words), found).otherwise(F.expr("cast(array() as array<string>)"))


def tests(col: Column) -> Column:
    """What patterns are tested with before they run: the ``folded`` text, and whether it is ASCII."""
    return F.struct(folded(col).alias("low"), is_ascii(col).alias("plain"))


def count_all(col: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col, F.lit(jrx(pattern, flags)))


def has(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(jrx(pattern, flags))


def spans(col: Column, pattern: str, flags: str = "") -> Column:
    """All matches with offsets: ``array<struct<start,end,text>>`` (0-based).

    One pass puts marks around the matches; what stands before a mark gives the
    offset. A text that holds a mark itself goes the longer way of ``spans_of``.
    """
    regex = jrx(pattern, flags)
    marked = F.regexp_replace(col, F.when(is_ascii(col), F.lit(ascii_jrx(pattern, flags))).otherwise(F.lit(regex)), F.lit(f"{MARK}$0{MARK}"))
    cut = between_marks(marked, 2, lambda m, start: F.struct(
        start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text")))
    return F.when(col.contains(MARK) | col.isNull(), spans_of(col, F.lit(regex))).otherwise(cut)


def spans_of_any(col: Column, low: Column, patterns) -> Column:
    """``spans`` of all (pattern, flags), one after the other; one whose literals ``low`` (``folded``) lacks is not run.

    What cuts the matches out is built once for all patterns: built for each, it is most of a gate's expression.
    """
    def marked(pattern: str, flags: str) -> Column:
        words, found = required(pattern), F.regexp_replace(col, jrx(pattern, flags), f"{MARK}$0{MARK}")
        return F.when(contains_any(low, words), found) if words else found

    texts = F.filter(F.array(*[marked(p, f) for p, f in patterns]), lambda t: t.isNotNull())
    cut = F.flatten(F.transform(texts, lambda t: between_marks(t, 2, lambda m, start: F.struct(
        start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text")))))
    plain = F.flatten(F.transform(literal_words([jrx(p, f) for p, f in patterns]), lambda r: spans_of(col, r)))
    return F.when(col.contains(MARK), plain).otherwise(cut)


def between_marks(marked: Column, added: int, body) -> Column:
    """``body(match, start)`` for each match of a text in which a match carries ``added`` marks, two of them around it."""
    none = F.expr("cast(array() as array<struct<start:int,m:string>>)")

    def fold(matches: Column, gaps: Column) -> Column:
        zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")), lambda acc, z: F.struct(
            (acc["pos"] + z["g"] + F.length(z["m"]) - (added - 2)).alias("pos"),
            F.concat(acc["out"], F.array(F.struct((acc["pos"] + z["g"]).alias("start"), z["m"].alias("m")))).alias("out")),
            lambda acc: acc["out"])

    def cut(parts: Column) -> Column:
        found = fold(F.filter(parts, lambda _, i: i % 2 == 1), F.filter(parts, lambda _, i: i % 2 == 0))
        return F.transform(F.when(F.size(parts) > 1, found).otherwise(none), lambda x: body(x["m"], x["start"]))
    return let(F.split(marked, MARK, -1), cut)


def spans_of(col: Column, regex: Column) -> Column:
    """``spans`` for a regex given as a column (already in Java form).

    Splitting on the pattern returns the gaps between exactly the matches that
    extract-all returns, so running lengths give exact offsets.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")

    def fold(matches: Column) -> Column:
        gaps = F.slice(F.split(col, regex, -1), F.lit(1), F.size(matches))
        zipped = F.zip_with(gaps, matches, lambda g, m: F.struct(
            F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")))
        return F.aggregate(
            zipped,
            F.struct(F.lit(0).alias("pos"), empty.alias("out")),
            lambda acc, z: F.struct(
                (acc["pos"] + z["g"] + z["n"]).alias("pos"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["pos"] + z["g"]).alias("start"),
                    (acc["pos"] + z["g"] + z["n"]).alias("end"),
                    z["m"].alias("text")))).alias("out")),
            lambda acc: acc["out"])

    return let(F.regexp_extract_all(col, regex, F.lit(0)), lambda m: F.when(F.size(m) > 0, fold(m)).otherwise(empty))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def collapse(col: Column) -> Column:
    """White-space runs to one space, ends trimmed. Runs that are one space already are left alone."""
    return F.trim(F.regexp_replace(col, rf"[{WS}&&[^ ]][{WS}]*| [{WS}]+", " "))


def literal_words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])

"""Pieces of DuckDB SQL shared by the oracle texts."""

from __future__ import annotations

from ..functions import rules
from ..functions.rx import WS, expand


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "") -> str:
    return q((f"(?{flags})" if flags else "") + expand(pattern))


def words_list(ws) -> str:
    return "[" + ", ".join(q(w) for w in ws) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def find_all(x: str, pattern: str, flags: str = "", group: int = 0) -> str:
    return f"regexp_extract_all({x}, {rx(pattern, flags)}, {group})"


def words_ws(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w<>'')"


def marked_sentences(x: str) -> str:
    """Sentence split without lookbehind: mark the cut, then split at the mark."""
    return f"string_split(regexp_replace({x}, '([.!?])[{WS}]+', '\\1'||chr(1), 'g'), chr(1))"


def expanded_sentences(x: str) -> str:
    return (f"list_filter(list_transform(flatten(list_transform({marked_sentences(x)},"
            f" lambda s: string_split_regex(s, '[\\n•*]+'))), lambda s: {strip('s')}), lambda s: len(s)>10)")


def lookbehind_sentences(x: str) -> str:
    return f"list_filter(list_transform({marked_sentences(x)}, lambda s: {strip('s')}), lambda s: len(s)>10)"


def terminator_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]+'), lambda s: {strip('s')}), lambda s: s<>'')"


def bounded_words(x: str) -> str:
    return (f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'),"
            f" lambda w: regexp_full_match(w, '[a-zA-Z]+'))")


def syllables(w: str, le: bool) -> str:
    g = f"len(regexp_extract_all(lower({w}), '[aeiouy]+'))"
    e = f"(case when lower({w}) like '%e' and {g}>1 then 1 else 0 end)"
    c = f"({g}-{e}" + (f"+(case when regexp_matches(lower({w}), '[^aeiouy]le$') then 1 else 0 end))" if le else ")")
    return f"(case when len({w})<=3 then 1 else greatest(1, {c}) end)"


def span_rows(name: str, src: str, pattern: str, flags: str = "", text: str = "t", keys: str = "pair_id, side") -> str:
    """CTE ``name(keys, i, s, e, m, t)``: matches with 0-based offsets, from gap lengths."""
    p = rx(pattern, flags)
    return f"""{name}_0 as (select {keys}, {text} t, regexp_extract_all({text}, {p}) ms,
 string_split_regex({text}, {p}) gs from {src}),
{name}_1 as (select {keys}, t, ms, gs, unnest(range(1, len(ms)+1)) i from {name}_0),
{name}_2 as (select {keys}, t, i, ms[i] m, cast(list_sum(list_transform(gs[1:i], lambda z: len(z)))
 + coalesce(list_sum(list_transform(ms[1:i-1], lambda z: len(z))), 0) as int) s from {name}_1),
{name} as (select {keys}, t, i, m, s, s+len(m) e from {name}_2)"""


NUMBER = rf"({rules.NUMBER})\s*({rules.UNITS_FIRST})?"
HEAD = rf"^({rules.NUMBER})"
TAIL = rf"^{rules.NUMBER}\s*"


def window(t: str, s: str, e: str, w: int) -> str:
    lo = f"greatest(0, {s}-{w})"
    return f"substr({t}, {lo}+1, {e}+{w}-{lo})"


def number_rows(name: str, src: str) -> str:
    """CTE ``name(pair_id, side, i, value, txt, unit, ctx)`` from ``src(pair_id, side, t)``."""
    return span_rows(name + "_sp", src, NUMBER, "i") + f""",
{name} as (select pair_id, side, i, cast(regexp_extract(m, {rx(HEAD)}, 1) as double) as value, regexp_extract(m, {rx(HEAD)}, 1) txt,
 nullif(lower(regexp_replace(m, {rx(TAIL)}, '')), '') unit, {window('t', 's', 'e', 30)} ctx from {name}_sp)"""


NOISE = rules.DATE_PATTERNS + rules.IGNORE_PATTERNS


def noisy(x: str) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {rx(p, f)})" for p, f in NOISE) + ")"


def bp_rows(name: str, src: str) -> str:
    """CTE ``name(pair_id, side, i, g, value, txt, unit, ctx)``: readings outside dates and ids."""
    parts = [f"{name}_src as (select pair_id, side, lower(t) t from {src} where regexp_matches(t, {rx(rules.BLOOD_PRESSURE, 'i')}))",
             span_rows(f"{name}_b", f"{name}_src", rules.BLOOD_PRESSURE, "i")]
    for k, (p, f) in enumerate(NOISE):
        parts.append(span_rows(f"{name}_n{k}", f"{name}_src", p, f))
    union = " union all ".join(f"select pair_id, side, s, e from {name}_n{k}" for k in range(len(NOISE)))
    bp = rx(rules.BLOOD_PRESSURE, "i")
    parts.append(f"""{name}_bad as ({union}),
{name} as (select b.pair_id, b.side, b.i, g, case g when 1 then regexp_extract(b.m, {bp}, 1) else regexp_extract(b.m, {bp}, 2) end txt,
 'mmhg' unit, {window('o.t', 'b.s', 'b.e', 20)} ctx from {name}_b b join {src} o on o.pair_id=b.pair_id and o.side=b.side,
 (values (1),(2)) v(g)
 where not exists (select 1 from {name}_bad x where x.pair_id=b.pair_id and x.side=b.side and x.s<=b.s and b.s<x.e))""")
    return ",\n".join(parts)


def sides(src: str) -> str:
    """Both texts of a pair as rows: ``tx(pair_id, side, t)``."""
    return f"tx as (select pair_id, 'o' side, original t from {src} union all select pair_id, 's', simplified from {src})"


def measurement_rows(src: str) -> str:
    """CTE ``ms(pair_id, side, ord, value, txt, unit, ctx)``: filtered numbers, then readings."""
    return f"""{sides(src)}, {number_rows('nu', 'tx')}, {bp_rows('bp', 'tx')},
ms as materialized (select pair_id, side, i ord, value, txt, unit, ctx from nu where not {noisy('ctx')}
 union all select pair_id, side, 1000000+2*i+g, cast(txt as double), txt, unit, ctx from bp)"""


def union_items(parts: list[str]) -> str:
    return "list_distinct(flatten([" + ", ".join(parts) + "]))"


def norm_set(x: str, patterns, norm, flags: str = "i") -> str:
    return union_items([f"list_transform({find_all(x, p, flags)}, lambda m: {norm('m')})" for p in patterns])


def lower_collapse(m: str) -> str:
    return collapse(f"lower({m})")


def fuzzy_missing(a: str, b: str) -> str:
    """Elements of list a with neither an equal element nor a shared number in b."""
    nums = lambda v: find_all(v, rules.ITEM_NUMBER)
    return (f"list_filter({a}, lambda x: not (list_contains({b}, x) or len(list_intersect({nums('x')},"
            f" flatten(list_transform({b}, lambda y: {nums('y')}))))>0))")


def exact_rounds(sql: str) -> str:
    """Spell every two-argument ``round(x, d)`` as exact binary rounding, ties to even."""
    out, i = "", 0
    while True:
        at = sql.find("round(", i)
        if at < 0:
            return out + sql[i:]
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            out, i = out + sql[i:at + 6], at + 6
            continue
        depth, quoted, commas, j = 1, False, [], at + 6
        while depth:
            ch = sql[j]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch in "([") - (ch in ")]")
                if ch == "," and depth == 1:
                    commas.append(j)
            j += 1
        x, k = exact_rounds(sql[at + 6:commas[-1]]), f"{10 ** int(sql[commas[-1] + 1:j - 1])}.0"
        p, err = f"(v*{k})", f"(((v*134217729.0-(v*134217729.0-v))*{k}-v*{k})+(v-(v*134217729.0-(v*134217729.0-v)))*{k})"
        up = (f"case when {p}-floor({p})<>0.5 then case when {p}-floor({p})>0.5 then 1.0 else 0.0 end"
              f" when {err}<>0 then case when {err}>0 then 1.0 else 0.0 end else floor({p})%2 end")
        out += sql[i:at] + f"list_transform([cast({x} as double)], lambda v: (floor({p})+{up})/{k})[1]"
        i = j

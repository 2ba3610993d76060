"""Set and vector comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rx import find_all, let
from .text import words_ws


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(empty))


def exact_round(x: Column, digits: int) -> Column:
    """Round the double's exact binary value, ties to even.

    The product x * 10^d is taken with its rounding error (split product), so a
    value just below a decimal tie is not lifted over it.
    """
    k = float(10 ** digits)

    def body(v: Column) -> Column:
        p, c = v * k, v * 134217729.0
        hi = c - (c - v)
        err = (hi * k - p) + (v - hi) * k
        low = F.floor(p).cast("double")
        up = F.when(p - low != 0.5, (p - low > 0.5).cast("double")).when(
            err != 0.0, (err > 0.0).cast("double")).otherwise(F.pmod(low, F.lit(2.0)))
        return (low + up) / k

    return let(x.cast("double"), body)


def jaccard(a: Column, b: Column) -> Column:
    """0 when either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0),
                  F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def word_jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(words_ws(F.lower(a)).alias("a"), words_ws(F.lower(b)).alias("b")), lambda w: jaccard(w["a"], w["b"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def unit_vector(v: Column) -> Column:
    """Scaled to length 1 so that later cosines are plain dot products."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def fuzzy_missing(a: Column, b: Column) -> Column:
    """Distinct elements of ``a`` with no equal element in ``b`` and no shared number with one.

    Null sides are empty. Numbers are looked for only when an element has no equal.
    """
    none = F.expr("cast(array() as array<string>)")

    def numbers(x: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(x, lambda v: find_all(v, rules.ITEM_NUMBER))))

    def search(s: Column) -> Column:
        return F.when(F.size(s["rest"]) == 0, none).otherwise(let(numbers(s["b"]), lambda n: F.filter(
            s["rest"], lambda x: ~F.arrays_overlap(find_all(x, rules.ITEM_NUMBER), n))))

    b = F.coalesce(b, none)
    return let(F.struct(F.array_except(F.coalesce(a, none), b).alias("rest"), b.alias("b")), search)

"""Near copies: SimHash links, checked by exact Jaccard similarity of word shingles, and the pairs that fingerprints miss.

Fingerprints at two bits or fewer are found by the Gray-order index of
``simhash``; their texts are compared exactly, and what links is one component.

Each text is its set of hashed shingles. Sets of n that overlap enough share one
of the first n - ceil(least * n) + 1 shingles in any order that all sets follow
(prefix filter), so no pair is lost. The order puts shingles of many texts last,
for which the most frequent ones are counted; the others come by hash. Sets of
different components that share a prefix shingle are compared exactly: first each
with two others, then with two of each bucket, then, in buckets that still hold
several components, between the components.
Parity bits of the sets go first: no two sets differ in more bits than shingles,
so pairs with too many are left out before any whole set travels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, small_batches
from .graph import components
from .simhash import fingerprint, near_links
from .tokens import row_keys

#: Shingles counted at a time, the least count in such a part, and the most shingles that the order knows by count.
PART, LEAST, HOT = 1 << 20, 2, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles; fewer than ``width`` words are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(h))
    if not size:
        return h
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i:i + len(out)]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _frequent(width: int):
    """(hash, n) of shingles that parts of the rows repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), width))
                size += len(held[-1])
                if size >= PART:
                    yield count(held)
                    held, size = [], 0
        if size:
            yield count(held)

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n >= LEAST].view(np.int64)), pa.array(n[n >= LEAST])], ["hash", "n"])
    return run


def prefix(s: np.ndarray, hot: np.ndarray, least: float) -> np.ndarray:
    """First shingles of a set in the order (place in ``hot`` by count, hash); ``hot`` has hashes and places, sorted by hash."""
    size = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    if not len(s):
        return s
    place = np.zeros(len(s), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], s), len(hot[0]) - 1)
        place = np.where(hot[0][at] == s, hot[1][at], 0)
    return s[np.argsort(place, kind="stable")[:size]]


def parity(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall into each of so many cells as twice the set, a power of two."""
    cells = max(64, 1 << (2 * len(s)).bit_length())
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least so many, from their parities."""
    a, b = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _signed(s: np.ndarray) -> int:
    """A number that stands for the set."""
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def _sets(width: int, least: float, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        for b in batches:
            node, size, first, bits, prints = [], [], [], [], []
            for t in b.column(b.num_columns - 1):
                s = shingles(t.as_py(), width)
                prints.append(fingerprint(t.as_py()))
                node.append(_signed(s))
                size.append(len(s))
                first.append(prefix(s, hot, least).view(np.int64))
                bits.append(parity(s))
            cols = [*b.columns, pa.array([next(keys) for _ in node], pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(first, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "_key", "_node", "_size", "_prefix", "_bits", "_print"])
    return run


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "set"])
    return run


def _likely(least: float):
    most = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)
            keep = pa.array([least_difference(x, y) <= most * (m + n) + 1e-6 for m, x, n, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)
    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(i)] for i in (2, 3))
            keep = pa.array([similarity(s, t) >= least for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)
    return run


def near_copies(docs: DataFrame, *, width: int = 5, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``component``, a number that all near copies share.

    Texts whose sets of ``width``-word shingles (words between white bytes, ASCII
    letters lowered) have a Jaccard similarity of ``least`` or more link, and so
    do equal sets; a component is what links reach. Shingles and sets are told
    apart by 64-bit hashes, otherwise the result is exact: no pair is left out.

    Null and blank texts have the empty set, which links only with itself. Rows
    may repeat. No rows give no rows. ``least`` lies above 0 and is 1 at most.
    ``docs`` may have columns of any names but ``component``.
    """
    keyed, named = _grouped(docs, width, least, text_col)
    out = keyed.select("_row", "_text", "_node").join(named, "_node", "left")
    return out.select(*_columns(docs, text_col), F.coalesce("component", "_node").alias("component"))


def without_copies(docs: DataFrame, *, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_copies``: that with the smallest id.

    Rows without an id come after all others, equal ids go by a stored number of the row. Rows are told apart by that
    number, so unlike texts may share an id and columns may have any name.
    """
    keyed, named = _grouped(docs, width, least, text_col)
    store = Store(docs.sparkSession, "copies")
    of = keyed.select("_key", "_node", F.col("_row")[id_col].alias("_id")).join(named, "_node", "left")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_key"))
    kept = of.groupBy(F.coalesce("component", "_node").alias("component")).agg(F.min(first)["_key"].alias("_key"))
    return keyed.join(store.keep(kept.select("_key")), "_key", "left_semi").select(*_columns(docs, text_col))


def _columns(docs: DataFrame, text_col: str) -> list:
    return [F.col("_text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]


def _grouped(docs: DataFrame, width: int, least: float, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``_row``, ``_text``, ``_key``, ``_node``: a number for the set) and (``_node``, ``component``) of linked sets."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and is 1 at most")
    small_batches(docs.sparkSession)
    store = Store(docs.sparkSession, "overlap")
    text = docs.select(F.col(text_col).cast("string").alias("_text"))
    seen = text.mapInArrow(_frequent(width), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "hash").limit(HOT).collect()
    h = np.array([r.hash for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    hot = (h[order], np.array([r.n for r in top], np.int64)[order])

    others = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("_none")]
    whole = docs.select(F.struct(*others).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    kind = (f"_row {whole.schema['_row'].dataType.simpleString()}, _text string, _key long, _node long, _size long, "
            "_prefix array<long>, _bits binary, _print long")
    keyed = store.keep(whole.mapInArrow(_sets(width, least, hot), kind))
    marks = store.keep(keyed.groupBy(F.col("_node").alias("node")).agg(
        F.first("_size").alias("size"), F.first("_prefix").alias("prefix"), F.first("_bits").alias("bits"), F.min("_print").alias("print")))
    bits = marks.select("node", "size", "bits")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.toDF("a", "m", "x"), "a").join(bits.toDF("b", "n", "y"), "b").select("a", "b", "m", "x", "n", "y")
        likely = store.keep(both.mapInArrow(_likely(least), "a long, b long"))
        used = store.keep(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        texts = keyed.select(F.col("_node").alias("node"), "_text").join(used, "node", "left_semi").groupBy("node").agg(F.min("_text").alias("text"))
        sets = store.keep(texts.mapInArrow(_packed(width), "node long, set binary"))
        both = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return store.keep(both.mapInArrow(_verified(least), "a long, b long"))

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # fingerprints choose the first pairs; sets of one fingerprint meet one of them
    prints = store.keep(marks.groupBy("print").agg(F.min("node").alias("node")))
    same = marks.select("node", "print").join(prints.withColumnRenamed("node", "to"), "print").filter("node <> to")
    tried = store.keep(near_links(prints).select(*ordered("a", "b")).union(same.select(*ordered("node", "to"))).distinct())
    links = linked(tried)
    named = store.keep(components(links))

    # buckets of several components. What tells them is combined before it travels, and both
    # sides of each join are stored, so a shingle that very many sets hold is split over tasks
    def opened(rows: DataFrame) -> DataFrame:
        """Stored rows (hash, pos, node, size, part) of the buckets that hold several components."""
        several = rows.groupBy("hash").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
        return store.keep(rows.join(store.keep(several.select("hash")).hint("merge"), "hash", "left_semi"))

    def parts(rows: DataFrame) -> DataFrame:
        return rows.join(named, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    alike = f"least(%s, %s) >= {least!r} * greatest(%s, %s) - 1e-6"
    rows = opened(parts(marks.select("node", "size", "prefix")).select(F.posexplode("prefix").alias("pos", "hash"), "node", "size", "part"))
    for few in (True, False):
        one = F.struct("part", "node", "size")
        ends = store.keep(rows.groupBy("hash").agg(F.min(one).alias("low"), F.max(one).alias("high")))
        near = rows.join(ends, "hash").select("node", "size", "part", F.explode(F.array("low", "high")).alias("to")).filter(
            alike % (("size", "to.size") * 2)).filter("part <> to.part")
        if few:  # each set meets two others at most, which joins most of a large group
            near = near.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high")).select(
                "node", F.explode(F.array("low", "high")).alias("to"))
        near = near.select(*ordered("node", "to.node")).distinct()
        more = store.keep(near.join(tried, ["a", "b"], "left_anti"))
        links, tried = links.union(linked(more)), tried.union(more)
        named = store.keep(components(links))
        rows = opened(parts(rows.drop("part")))
    # shingles before the shared one are of one set only, and so many must be shared in all
    reach = f"least(x.size - x.pos, y.size - y.pos) >= {least / (1 + least)!r} * (x.size + y.size) - 1e-6"
    more = rows.alias("x").join(rows.alias("y"), F.expr(
        "x.hash = y.hash and x.node < y.node and x.part <> y.part and " + alike % (("x.size", "y.size") * 2))).filter(F.expr(reach))
    more = more.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(linked(store.keep(more)))
    done = store.n
    named = store.keep(components(links))
    store.drop(*range(2, done + 1))  # all but the rows
    return keyed, named.withColumnRenamed("node", "_node")

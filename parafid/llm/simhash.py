"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint is turned so that one of three bit blocks comes first; two
fingerprints that differ in two bits at most agree in one block at least. Per
block, fingerprints are range-sorted by Gray rank, in which neighbours share
long bit patterns, and cut into pages. Inside a page they form a tree: a node
keeps the bits that all below it share (mask and pattern), and a pair of nodes
whose shared bits already differ too often is dropped with all pairs below it.
A block value whose run goes over the end of a page is compared page by page,
where the pages' own masks and patterns prune first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store
from .graph import components, local_labels
from .registry import query, table

BITS, FAN = 64, 16
#: Left turns that bring each of the three blocks of 21 bits to the top; bit 42 is in none of them.
TURNS, BLOCK = (0, 22, 43), 21


# --------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones, step = np.zeros(BITS, np.int64), 1 << 14
    for i in range(0, len(h), step):
        ones += np.unpackbits(h[i:i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) of every document; null text has no words."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_prints, "id long, print long")


# ------------------------------------------------------------------ the index
def gray_rank(x: Column) -> Column:
    """Place of a 64-bit pattern in the reflected Gray order; ``x = r ^ (r >>> 1)`` undoes it."""
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, n))
    return x


def turned(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, BITS - n)) if n else x


def _pages(size: int):
    """Cuts rows in (turn, rank) order into pages of ``size`` of one turn."""
    def page(turn: int, rank: np.ndarray, node: np.ndarray) -> dict:
        code = rank ^ (rank >> np.uint64(1))
        low, high = np.bitwise_and.reduce(code), np.bitwise_or.reduce(code)
        key = rank[[0, -1]] >> np.uint64(BITS - BLOCK)
        return {"turn": turn, "page": int(rank[:1].view(np.int64)[0]), "first": int(key[0]), "last": int(key[1]),
                "pattern": int(low.reshape(1).view(np.int64)[0]), "mask": int((~(low ^ high)).reshape(1).view(np.int64)[0]),
                "codes": code.tobytes(), "nodes": node.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            if sum(len(x[0]) for x in held) >= size * 4:
                held = yield from flush(held, False)
        yield from flush(held, True)

    def flush(held, end: bool):
        if not held:
            return []
        turn, rank, node = (np.concatenate(x) for x in zip(*held, strict=True))
        rank, out, at = rank.astype(np.int64).view(np.uint64), [], 0
        rank = rank ^ np.uint64(1 << 63)  # sorted as signed numbers, with the sign turned round
        while at < len(turn):
            stop = min(at + size, at + int(np.searchsorted(turn[at:], turn[at], "right")))
            if stop == len(turn) and not end:
                break
            out.append(page(int(turn[at]), rank[at:stop], node[at:stop].astype(np.int64)))
            at = stop
        if out:
            yield pa.RecordBatch.from_pylist(out, _PAGE)
        return [(turn[at:], (rank[at:] ^ np.uint64(1 << 63)).view(np.int64), node[at:])] if at < len(turn) else []
    return run


_PAGE = pa.schema([("turn", pa.int32()), *((c, pa.int64()) for c in ("page", "first", "last", "pattern", "mask")),
                   ("codes", pa.binary()), ("nodes", pa.binary())])
_PAGE_SQL = "turn int, page long, first long, last long, pattern long, mask long, codes binary, nodes binary"


def _levels(code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level, leaves first."""
    levels, low, high = [(code, np.full(len(code), ~np.uint64(0)))], code, code
    while len(low) > FAN:
        cuts = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
        levels.append((low, ~(low ^ high)))
    return levels


def near_pairs(a: np.ndarray, b: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of codes that differ in ``most`` bits or fewer; b None: pairs i < j inside a."""
    x, y = _levels(a), _levels(a if b is None else b)
    while len(x) < len(y):
        x.append(x[-1])
    while len(y) < len(x):
        y.append(y[-1])
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(x[-1][0])), np.arange(len(y[-1][0])), indexing="ij"))
    for k in range(len(x) - 1, -1, -1):
        (px, mx), (py, my) = x[k], y[k]
        if b is None:
            keep = i <= j if k else i < j
            i, j = i[keep], j[keep]
        keep = np.bitwise_count((px[i] ^ py[j]) & mx[i] & my[j]) <= most
        i, j = i[keep], j[keep]
        if k:
            i, j = _below(i, j, len(x[k - 1][0]), len(x[k][0]), len(y[k - 1][0]), len(y[k][0]))
    return i, j


def _below(i, j, nx: int, mx: int, ny: int, my: int):
    """All pairs of children of the pairs of nodes; a level that was repeated has one child each."""
    fx, fy = (1 if nx == mx else FAN), (1 if ny == my else FAN)
    i = (i[:, None, None] * fx + np.arange(fx)[None, :, None] + np.zeros((1, 1, fy), int)).ravel()
    j = (j[:, None, None] * fy + np.arange(fy)[None, None, :] + np.zeros((1, fx, 1), int)).ravel()
    keep = (i < nx) & (j < ny)
    return i[keep], j[keep]


def _edges(node_a: np.ndarray, node_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as the pairs do, one for each node at most."""
    if not len(i):
        return []
    names, place = np.unique(np.concatenate([node_a[i], node_b[j]]), return_inverse=True)
    label = local_labels(len(names), place[:len(i)], place[len(i):])
    own = label != np.arange(len(names))
    return list(zip(names[own].tolist(), names[label[own]].tolist(), strict=True))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for r in range(b.num_rows):
                x = [np.frombuffer(c[r].as_py(), t) for c, t in zip(b.columns, (np.uint64, np.int64) * 2, strict=False)]
                i, j = near_pairs(x[0], x[2] if pairs else None, most)
                found.update(_edges(x[1], x[3 if pairs else 1], i, j))
            if found:
                yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in found], _LINK)
    return run


def near_links(prints: DataFrame, most: int = 2, page_rows: int = 4096) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node long, print long; prints distinct).

    They join the same nodes as all pairs at ``most`` (2 at most) bits do, but
    repeat only what each page needs. Nothing is dropped: each pair shares a
    block value, and the rows of a value share a page or meet in a page pair.
    """
    if most > len(TURNS) - 1:
        raise ValueError("three blocks find pairs at two bits at most")
    store = Store(prints.sparkSession, "simhash-pages")
    sign = F.lit(-(1 << 63))
    rows = prints.select("node", F.explode(F.array(*[
        F.struct(F.lit(k).alias("turn"), gray_rank(turned(F.col("print"), n)).bitwiseXOR(sign).alias("rank"))
        for k, n in enumerate(TURNS)])).alias("x")).select("x.turn", "x.rank", "node")
    rows = rows.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    pages = store.keep(rows.mapInArrow(_pages(page_rows), _PAGE_SQL))
    inside = pages.select("codes", "nodes").mapInArrow(_links(False, most), "a long, b long")
    edge = pages.select("turn", "page", "pattern", "mask", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    pair = edge.alias("x").join(edge.alias("y"), F.expr("x.turn = y.turn and x.key = y.key and x.page <> y.page")).filter(
        F.expr(f"bit_count((x.pattern ^ y.pattern) & x.mask & y.mask) <= {int(most)}")).select(
        F.col("x.turn").alias("turn"), F.col("x.page").alias("p"), F.col("y.page").alias("q")).filter("p < q").distinct()
    side = pages.select("turn", "page", "codes", "nodes")
    across = (pair.join(side.toDF("turn", "p", "codes", "nodes"), ["turn", "p"])
              .join(side.toDF("turn", "q", "codes2", "nodes2"), ["turn", "q"])
              .select("codes", "nodes", "codes2", "nodes2").mapInArrow(_links(True, most), "a long, b long"))
    return inside.union(across)


def near_duplicates(docs: DataFrame, *, most: int = 2, page_rows: int = 4096, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: its id, ``fingerprint`` (16 hex digits), ``component_id`` and ``keep``.

    Fingerprints at ``most`` or fewer differing bits link; ``component_id`` is
    the smallest id reachable, and ``keep`` marks that one document. Equal
    fingerprints are one node of the graph, whatever their number.

    Null and blank texts have fingerprint zero and link like any other. A null
    id has a fingerprint but no component, links nothing and is kept. Rows that
    repeat an id each give a row. No rows give no rows; other columns are not read.
    """
    store = Store(docs.sparkSession, "simhash")
    prints = store.keep(fingerprints(docs, id_col, text_col))
    nodes = store.keep(prints.filter("id is not null").groupBy("print").agg(F.min("id").alias("node")))
    named = components(near_links(nodes, most, page_rows))
    of = store.keep(nodes.join(named, "node", "left").select("print", F.coalesce("component", "node").alias("component")))
    out = prints.join(of, "print", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component")))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                      "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("keep"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

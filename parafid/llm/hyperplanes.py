"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosines, components.

Vectors are hashed by the signs of random hyperplanes in several tables; rows
that share a table's bucket are compared in blocks, exactly and in double
precision. Equal vectors are one row with a count. A bucket of any size is cut
into blocks, and blocks of one bucket meet pairwise, so no task holds more than
two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store
from .graph import components, local_labels
from .registry import query, table

NULL_BYTES = pa.binary()


def planes_for(rows: int, threshold: float, recall: float, bucket_rows: int) -> tuple[int, int]:
    """(planes in a table, tables): buckets of about ``bucket_rows`` unrelated rows, and enough
    tables that a pair exactly at the threshold shares a bucket with probability ``recall``."""
    bits = min(62, max(6, math.ceil(math.log2(max(rows, 1) / bucket_rows)) if rows > bucket_rows else 0))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _buckets(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of each row in each table; planes depend on the seed and the dimension alone."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], bits * tables))
    signs = (unit @ planes >= 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes of the vector as doubles or floats; null if it can't be compared)."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = None
            if v and None not in v:
                x = np.asarray(v, np.float64)
                x = (x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "vec"])


def _hashed(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                raw, by_dim = c.column(2).to_pylist(), {}
                for i, v in enumerate(raw):
                    by_dim.setdefault(len(v), []).append(i)
                for dim, rows in by_dim.items():
                    unit = _unit(np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1))
                    key = _buckets(unit, bits, tables, seed)
                    take = pa.array(np.tile(rows, tables))
                    t = np.repeat(np.arange(tables, dtype=np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t), pa.array(np.full(len(t), dim // 8, np.int32)), pa.array(key.T.ravel()),
                         *(c.column(k).take(take) for k in range(3))], ["t", "dim", "bucket", "node", "n", "vec"])
    return run


_OUT_SQL = ("node long, links long, label long, t int, dim int, bucket long, page long, nodes binary, ns binary, vecs binary")
_OUT = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("t", pa.int32()), ("dim", pa.int32()),
                  ("bucket", pa.int64()), ("page", pa.int64()), ("nodes", NULL_BYTES), ("ns", NULL_BYTES), ("vecs", NULL_BYTES)])


class _Block:
    """Rows of one bucket of one table."""

    def __init__(self, nodes: np.ndarray, ns: np.ndarray, vecs: bytes, bits: int, tables: int, seed: int):
        self.nodes, self.ns, self.vecs = nodes, ns, vecs
        self.unit = _unit(np.frombuffer(vecs, np.float64).reshape(len(nodes), -1))
        self.keys = _buckets(self.unit, bits, tables, seed)


def _compare(x: _Block, y: _Block | None, t: int, threshold: float) -> list[dict]:
    """What the links of two blocks, or inside one, add to each of their rows.

    A pair that shares a bucket of an earlier table was counted there.
    """
    z = y or x
    i, j = np.nonzero(x.unit @ z.unit.T >= threshold)
    if y is None:
        i, j = i[i < j], j[i < j]
    if t:
        new = np.ones(len(i), bool)
        for k in range(t):
            new &= x.keys[i, k] != z.keys[j, k]
        i, j = i[new], j[new]
    if not len(i):
        return []
    names, place = np.unique(np.concatenate([x.nodes[i], z.nodes[j]]), return_inverse=True)
    a, b = place[:len(i)], place[len(i):]
    links = np.zeros(len(names), np.int64)
    np.add.at(links, a, z.ns[j])
    np.add.at(links, b, x.ns[i])
    label = names[local_labels(len(names), a, b)]
    return [{"node": int(n), "links": int(k), "label": int(m)} for n, k, m in zip(names, links, label, strict=True)]


def _inside(bits: int, tables: int, seed: int, threshold: float, size: int):
    """Compares within blocks; hands on the blocks of buckets that have, or may have, others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, count, key = [], True, 0, None

        def close(last: bool, full: bool) -> list[dict]:
            nonlocal first, count
            nodes, ns = (np.array([r[k] for r in held], np.int64) for k in (3, 4))
            block = _Block(nodes, ns, b"".join(r[5] for r in held), bits, tables, seed)
            out = _compare(block, None, key[0], threshold) if len(held) > 1 else []
            if first or last or full or count:
                out.append({"t": key[0], "dim": key[1], "bucket": key[2], "page": int(nodes.min()), "nodes": nodes.tobytes(),
                            "ns": ns.tobytes(), "vecs": block.vecs})
            count = count + 1 if full else 0
            first = first and full
            held.clear()
            return out

        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:3] != key:
                    out += close(False, False)
                elif len(held) >= size:
                    out += close(False, True)
                key = r[:3]
                held.append(r)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, _OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _OUT)
        if held:
            yield pa.RecordBatch.from_pylist(close(True, False), _OUT)
    return run


def _across(bits: int, tables: int, seed: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = [c[i].as_py() for c in b.columns]
                x, y = (_Block(np.frombuffer(r[k], np.int64), np.frombuffer(r[k + 1], np.int64), r[k + 2], bits, tables, seed)
                        for k in (1, 4))
                out = _compare(x, y, r[0], threshold)
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ADD)
    return run


_ADD = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.995, bucket_rows: int = 512,
                    block_rows: int = 2048, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: its id, ``n_links`` (others at cosine >= ``threshold``), ``component_id`` and ``kept``.

    Pairs below the threshold never link. A pair at the threshold is found with
    probability ``recall``, a closer one with more. ``component_id`` is the
    smallest id reachable by links, and ``kept`` marks that vector. Planes and
    tables follow the number of different vectors (``planes_for``).

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing; so do vectors of different lengths with each other. A
    null id links with nothing, has no component and is not kept. Rows that
    repeat an id count one by one. No rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "hyperplanes")
    rows = store.keep(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
                      .mapInArrow(_clean, "id long, vec binary"))
    classes = store.keep(rows.filter("id is not null and vec is not null").groupBy("vec").agg(
        F.min("id").alias("node"), F.count("*").alias("n")))
    bits, tables = planes_for(classes.count(), threshold, recall, bucket_rows)
    hashed = classes.select("node", "n", "vec").mapInArrow(
        _hashed(bits, tables, seed), "t int, dim int, bucket long, node long, n long, vec binary")
    hashed = hashed.withColumn("_salt", F.xxhash64("node")).repartitionByRange("t", "dim", "bucket", "_salt")
    hashed = hashed.sortWithinPartitions("t", "dim", "bucket").drop("_salt")
    found = store.keep(hashed.mapInArrow(_inside(bits, tables, seed, threshold, block_rows), _OUT_SQL))
    pages = found.filter("page is not null")
    x, y = (pages.select("t", "dim", "bucket", *(F.col(c).alias(c + k) for c in ("page", "nodes", "ns", "vecs"))) for k in "xy")
    pairs = x.join(y, ["t", "dim", "bucket"]).filter("pagex < pagey").select("t", "nodesx", "nsx", "vecsx", "nodesy", "nsy", "vecsy")
    more = pairs.mapInArrow(_across(bits, tables, seed, threshold), "node long, links long, label long")
    added = store.keep(found.filter("node is not null").select("node", "links", "label").union(more))
    named = components(added.select(F.col("node").alias("a"), F.col("label").alias("b")))
    of = classes.join(added.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(named, "node", "left")
    of = store.keep(of.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                              F.coalesce("component", "node").alias("component")))
    out = rows.join(of, "vec", "left")
    known = F.col("id").isNotNull()
    out = out.withColumn("component_id", F.when(known, F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
                      "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


_ORACLE = """
with recursive v as materialized (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[],embedding::double[])) as m from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id<>b.vec_id
  where a.m>0 and b.m>0 and list_inner_product(a.e,b.e)/(a.m*b.m)>=0.9),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b=l.a)
select vec_id, (select count(*) from l where l.a=vec_id) as n_links,
  least(vec_id, coalesce((select min(b) from r where r.a=vec_id), vec_id)) as component_id,
  vec_id = least(vec_id, coalesce((select min(b) from r where r.a=vec_id), vec_id)) as kept from embeddings
"""


@query("op2_embedding_near_dedup", _ORACLE)
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

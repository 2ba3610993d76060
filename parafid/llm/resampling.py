"""Importance resampling towards a target distribution.

A regex split of an untrained pre-tokenizer gives the words of ASCII-lowered
text with their offsets. Windows over the offsets are the features; each falls
into a bucket by its CRC. Bucket counts of the corpus and of the target give
every bucket a gain (a table of fixed size), a document's weight is the sum over
its features, and Gumbel noise from a hash of its id makes the highest scores a
draw without replacement. Ranks come from key ranges: each is put in order by
itself, behind the sum of the ranges before it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Store
from .registry import query, table
from .tokens import no_cycles, once_a_worker, parts, row_keys

#: Words, and a place between two of them; ASCII letters are lowered before.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: Features whose buckets a worker keeps.
KEPT = 1 << 17


# ------------------------------------------------------------------- features
class Buckets(dict):
    """Bucket of each feature, found when it is first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        found = zlib.crc32(feature.encode()) % self.buckets
        if len(self) >= KEPT:
            self.clear()
        if len(feature) <= 64:
            self[feature] = found
        return found


def word_split():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    return Split(Regex(WORD), "removed", invert=True)


def features(text: str, split, least: int, most: int) -> Iterator[str]:
    """All runs of ``least`` to ``most`` consecutive words of a lowered text, joined by one space."""
    tail: list[str] = []  # words before a part that runs may begin with
    for part in parts(text, GAP):
        got = split.pre_tokenize_str(part)
        if most == 1:
            yield from (w for w, _ in got)
            continue
        offsets = [o for _, o in got]
        words = tail + [part[s:e] for s, e in offsets]
        for n in range(least, most + 1):
            # windows that end in this part
            first = max(len(tail) - n + 1, 0)
            yield from (" ".join(words[i:i + n]) for i in range(first, len(words) - n + 1))
        tail = words[len(words) - most + 1:] if len(words) >= most else words


def _histograms(least: int, most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bucket, keys = once_a_worker(word_split), once_a_worker(Buckets, buckets), row_keys()
        for b in batches:
            ids, ends, key, words, n = [], [0], [], [], []
            for t in b.column(1):
                text = (t.as_py() or "").translate(_LOWER)
                with no_cycles():
                    found = np.fromiter(map(bucket.__getitem__, features(text, split, least, most)), np.int64)
                got, times = np.unique(found, return_counts=True)
                ids.append(got)
                n.append(times)
                ends.append(ends[-1] + len(got))
                key.append(next(keys))
                words.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.int64()), pa.array(words, pa.int64()), *lists],
                                             ["id", "key", "n_features", "bucket", "n"])
    return run


def histograms(docs: DataFrame, *, least: int = 1, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``key`` (tells rows apart), ``n_features``, and the buckets of its features with their counts."""
    if not 1 <= least <= most or buckets < 1:
        raise ValueError("runs have one word at least, and there is one bucket at least")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    kind = f"id {d.schema[0].dataType.simpleString()}, key long, n_features long, bucket array<int>, n array<int>"
    return d.mapInArrow(_histograms(least, most, buckets), kind)


def _total(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (c.flatten().to_numpy() for c in b.columns)
            np.add.at(sums, at, n)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["bucket", "n"])
    return run


def totals(hist: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; tasks send their sums only, ``buckets`` numbers at most."""
    got = hist.select("bucket", "n").mapInArrow(_total(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in thousandths, rounded down."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + k) / ((int(x) + 1) * (t + k)))) for x, y in zip(source, target, strict=True)],
                    np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column(3), b.column(4).flatten().to_numpy().astype(np.int64)
            ends = at.offsets.to_numpy() - at.offsets[0].as_py()
            sums = np.concatenate([[0], np.cumsum(gain[at.flatten().to_numpy()] * n)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["id", "key", "n_features", "weight"])
    return run


# ----------------------------------------------------------------------- draw
def ranked(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, rank): rows (score, id, key) in order of score, highest first, then id, nulls last, then key.

    Rows are dealt to ranges of that order and stored with the number of their range; only counts of ranges are summed
    up in one place. A range is as large as others even if all scores are equal, because keys differ.
    """
    store, order = Store(rows.sparkSession, "ranks"), [F.desc("score"), F.asc_nulls_last("id"), F.asc("key")]
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.keep(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))  # one row for each range
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select(
        "key", (F.col("place") + F.col("before")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1,
             buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Per document: its id, ``n_features``, ``weight``, ``score`` and ``rank`` (null if it is not drawn).

    Features are all runs of ``least`` to ``most`` words. Of the documents with ``least_words`` features or more,
    ``percent`` of a hundred, rounded down, are drawn: those with the highest scores, ties to the smaller id.

    Null and empty texts have no features and weight 0. A null id hashes as ``null`` and comes last in a tie; rows that
    repeat an id share their noise and are drawn one by one. An empty target weighs by rarity alone. No rows give no
    rows. Columns other than those named are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "resampling")
    shape = {"least": least, "most": most, "buckets": buckets}
    hist = store.keep(histograms(docs, id_col=id_col, text_col=text_col, **shape))
    kind = hist.schema["id"].dataType.simpleString()
    wanted = totals(histograms(target, id_col=target_col, text_col=target_col, **shape), buckets)
    gain = gains(totals(hist, buckets), wanted)
    w = hist.mapInArrow(_weigh(gain), f"id {kind}, key long, n_features long, weight long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    w = store.keep(w.withColumn("score", F.col("weight") + noise))
    able = w.filter(F.col("n_features") >= least_words)
    drawn = percent * able.count() // 100
    rank = ranked(able.select("score", "id", "key")).filter(F.col("rank") <= drawn)
    return w.join(rank, "key", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


# CRC-32 of words in SQL: its table from the polynomial, then byte by byte; only different words are looked at.
_ORACLE = r"""
with recursive bits as (select i, i as v, 0 as k from range(256) t(i) union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
tab as (select list(v order by i) as l from bits where k = 8),
low as (select doc_id, text as raw, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from low),
target as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
uniq as (select distinct w, hex(encode(w)) as hx from (select w from words union all select w from target)),
crc as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2*i+1:2*i+2])::bigint)),
  lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from uniq, tab),
s as (select bucket, count(*) as n from words join crc using (w) group by 1),
t as (select bucket, count(*) as n from target join crc using (w) group by 1),
g as (select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double /
  ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
  from (select unnest(range(10000)) as bucket) b left join s using (bucket) left join t using (bucket)),
wt as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from words join crc using (w) join g using (bucket) group by 1),
sc as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score
  from low left join wt using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from sc where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from r) then rank end::bigint as rank
from sc left join r using (doc_id)
"""


@query("op13_importance_resampling", _ORACLE)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

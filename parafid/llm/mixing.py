"""Mixing sources to target weights.

Documents get hash-random keys and are put in key order within their source.
Prefix sums of word counts are distributed: a source's key space is cut into
equal ranges by its number of rows, each (source, range) is summed first, the
sums of the ranges before are added (in blocks of ranges, so that no task holds
all of a source's), and only the rows of one range are put in order by one
task. A source is cut at its exact budget; whole epochs come before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Store, white_words
from .registry import query, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Adds ``weight``, ``target`` and ``budget`` to ``sizes`` (source, source_size).

    All targets together are ``share`` times all sizes. Each source has its
    weight's part of that, but ``limit`` times its own size at most; what is
    beyond goes to the others by weight, again and again. The fixed point is
    found directly: with sources in order of limit over weight, those before
    some place are at their limit and the rest share what is left by weight.
    One row per source passes through one task, no documents.
    """
    order, cap = W.orderBy(F.col("source").asc_nulls_last()), F.lit(float(limit)) * F.col("source_size")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("_cap", cap)
    by = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, all_ = (by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing),
                          by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(all_)
                     - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_rate", F.col("_left") / F.sum("weight").over(rest))
    open_ = F.col("_rate") * F.col("weight") < F.col("_cap")
    rate = F.first(F.when(open_, F.col("_rate")), ignorenulls=True).over(all_)
    s = s.withColumn("_shared", rate).withColumn("_n", F.row_number().over(by))
    start = F.min(F.when(open_, F.col("_n"))).over(all_)
    s = s.withColumn("_start", start)
    target = F.when(F.col("_n") >= F.col("_start"), F.col("_shared") * F.col("weight")).otherwise(F.col("_cap"))
    return (s.withColumn("target", target).withColumn("budget", F.floor("target").cast("long"))
            .select("source", "source_size", "weight", "target", "budget"))


def _before(col: str, keys: list, order: list):
    rows = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(col).over(rows), F.lit(0))


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, seed: str = "mix",
        rows_per_range: int = 512, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text") -> DataFrame:
    """Per document: its id, ``source``, ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` counts the words that the mix takes of a document, repeats
    counted; within a source it adds up to the floor of the source's target.
    The order of a source's documents is that of md5(seed, id), so reruns agree.

    Null text has size 0, a null source is a source of its own (the last one),
    a null id is ordered after all others; rows that repeat an id are all kept
    and share their source's budget. Ties in the key are broken by size. No
    rows give no rows. Columns other than the three named are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "mix")
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(id_col).cast("string")))
    d = store.keep(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                               white_words(F.col(text_col)).alias("size"), key.alias("_key")))
    sizes = store.keep(d.groupBy("source").agg(F.ceil(F.count("*") / rows_per_range).alias("_ranges")))
    place = F.coalesce(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit((1 << 32) - 1))
    d = d.alias("d").join(sizes.alias("n"), F.expr("d.source <=> n.source")).select(
        "_id", "d.source", "size", "_key", F.floor(place * F.col("_ranges") / (1 << 32)).alias("_range"))
    sums = d.groupBy("source", "_range").agg(F.sum("size").alias("_sum")).withColumn("_block", F.expr("_range div 1024"))
    blocks = sums.groupBy("source", "_block").agg(F.sum("_sum").alias("_sum"))
    blocks = blocks.withColumn("_ahead", _before("_sum", ["source"], ["_block"])).drop("_sum")
    base = sums.withColumn("_base", _before("_sum", ["source", "_block"], ["_range"])).alias("s").join(
        blocks.alias("b"), F.expr("s.source <=> b.source and s._block = b._block")).select(
        "s.source", "_range", "_sum", (F.col("_base") + F.col("_ahead")).alias("_base"))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, limit)
    plan = store.keep(base.join(goals, base["source"].eqNullSafe(goals["source"])).select(
        base["source"], "_range", "_base", "source_size", "target", "budget"))
    d = d.withColumn("_before", _before("size", ["source", "_range"], [F.col("_key").asc_nulls_last(), "size", "_id"]))
    d = d.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source and d._range = p._range"))
    last = F.col("budget") % F.col("source_size")
    part = F.least(F.greatest(last - F.col("_base") - F.col("_before"), F.lit(0)), F.col("size"))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.expr("budget div source_size") * F.col("size") + part)
    return d.select(F.col("_id").alias(id_col), F.col("d.source").alias("source"), "size", "source_size", "target",
                    taken.cast("long").alias("taken"))


_ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+'))::bigint as size,
  md5('mix:'||doc_id::varchar) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [3.0,1.0,2.0][((row_number() over (order by source nulls last)-1)%3+1)::int]::double as weight, 2.0*source_size as cap from s),
r as (select *, row_number() over (order by cap/weight, source nulls last) as n,
  (1.5*sum(source_size) over ()-coalesce(sum(cap) over (order by cap/weight, source nulls last rows between unbounded preceding and 1 preceding),0))::double as rest,
  sum(weight) over (order by cap/weight, source nulls last rows between current row and unbounded following)::double as ws from w),
o as (select min(n) as n0, min_by(rest/ws, n) as rate from r where rest/ws*weight < cap),
t as (select source, source_size, case when n>=n0 then rate*weight else cap end::double as target from r, o),
p as (select d.*, coalesce(sum(size) over (partition by source order by k nulls last, size, doc_id rows between unbounded preceding and 1 preceding),0) as b from d)
select doc_id, size, source_size, target, (case when size=0 then 0 else (floor(target)::bigint // source_size)*size
  + least(greatest(floor(target)::bigint % source_size - b, 0), size) end)::bigint as taken
from p join t on p.source is not distinct from t.source
"""


@query("op7_mix_sources", _ORACLE)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""A stored inverted index of the synonyms, read in blocks of falling contribution.

Below the index's folder lie three Parquet tables.

* ``postings``: blocks of some ``ROWS`` rows that share a key and a level. Keys are tokens (kind ``t``), pairs of
  neighbouring tokens (``p``) and whole lower-cased terms (``e``). The level is the row's contribution in steps, so
  all rows of a block contribute alike and a block's bound is known without reading it.
* ``keys``: for each key its rows, best contribution and the rows and best contribution of each of its levels.
* ``stats``: the figures of the whole. It is written last; a folder without it is no index.

A block's folder follows from a hash of key, level and block, so the blocks of a frequent key lie in all folders, no
task writes or joins more of them than another, and a lookup opens the folders of the blocks that it wants.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.rx import let, once
from ..plans.checkpoints import cut

#: Rows of a block, about: blocks of a level are cut by a hash of the row.
ROWS = 128
#: Levels for each unit of contribution; contributions end at 2.2, so a key has 36 levels at most.
STEPS = 16
#: Levels of keys that go to every task at most, when blocks are cut.
FEW = 100_000

FIELDS = ("cui", "term", "term_lower", "is_preferred", "semantic_types", "ord")


def usable() -> Column:
    """Whether a row can be stored: it has a concept and a term."""
    return F.col("cui").isNotNull() & F.col("term").isNotNull() & F.col("term_lower").isNotNull()


def write_index(synonyms: DataFrame, path: str, buckets: int = 64, force: bool = True) -> TermIndex:
    """Index the rows of ``synonyms`` that have a concept and a term, below ``path``.

    Repeated rows are rows of their own; an empty table gives an empty index. With ``force=False`` a finished index
    stays as it is. ``buckets`` is the number of folders, and of tasks that write; take one for some million entries.
    """
    from .terms import fold_analyzer
    spark = synonyms.sparkSession
    done = TermIndex(spark, path)
    if not force and done.finished():
        return done
    s = cut(synonyms.filter(usable()).select(*FIELDS[:-1], F.col("ord").cast("long").alias("ord")).withColumn("s_tokens", fold_analyzer(F.col("term"))))
    n, avgdl = s.agg(F.count(F.lit(1)), F.avg(F.size("s_tokens"))).first()
    entries = _entries(s, float(avgdl or 1.0))
    levels = cut(entries.groupBy("kind", "key", "level").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("best")))
    several = levels.filter(F.col("n") > ROWS).select("kind", "key", "level", _blocks(F.col("n")).alias("blocks"))
    several = F.broadcast(several) if several.count() <= FEW else several
    block = F.pmod(F.xxhash64("row.cui", "row.term_lower", "row.ord"), F.coalesce("blocks", F.lit(1))).cast("int")
    cut_up = entries.join(several, ["kind", "key", "level"], "left").withColumn("block", block)
    # one shuffle, by folder: grouping by folder and block needs no other
    posted = cut_up.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").groupBy(
        "bucket", "kind", "key", "level", "block").agg(F.collect_list("row").alias("rows"))
    posted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # whole terms of one block are not listed: there is nothing to choose
    listed = levels.filter((F.col("kind") != "e") | (F.col("n") > ROWS)).withColumn("bucket", _key_bucket(buckets))
    listed.repartition(buckets, "bucket").groupBy("bucket", "kind", "key").agg(
        F.sum("n").alias("df"), F.max("best").alias("part"),
        F.sort_array(F.collect_list(F.struct("level", "n", "best")), asc=False).alias("levels"),
    ).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")
    spark.range(1).select(F.lit(n).alias("rows"), F.lit(float(avgdl or 1.0)).alias("avgdl"), F.lit(buckets).alias("buckets")).coalesce(
        1).write.mode("overwrite").parquet(f"{path}/stats")
    return TermIndex(spark, path)


def _entries(s: DataFrame, avgdl: float) -> DataFrame:
    """(row, kind, key, part, level): the contribution is the token's, of pairs the best of the row's tokens."""
    from .terms import _saturation
    dl = F.size("s_tokens")
    parts = F.transform(F.array_distinct("s_tokens"), lambda t: F.struct(F.lit("t").alias("kind"), t.alias("key"), _saturation(
        F.size(F.filter("s_tokens", lambda x: x == t)), dl, F.lit(avgdl)).alias("part")))
    peak = F.coalesce(F.array_max(F.transform("parts", lambda p: p["part"])), F.lit(0.0))
    pair = F.transform(F.array_distinct(pairs(F.col("s_tokens"))), lambda g: F.struct(F.lit("p").alias("kind"), g.alias("key"), peak.alias("part")))
    whole = F.array(F.struct(F.lit("e").alias("kind"), F.col("term_lower").alias("key"), F.lit(0.0).alias("part")))
    row = F.struct(F.col("cui"), F.col("term").alias("syn_term"), *FIELDS[2:], "s_tokens").alias("row")
    out = s.withColumn("parts", parts).select(row, F.inline(once(F.concat("parts", pair, whole))))
    return out.withColumn("level", F.floor(F.col("part") * STEPS).cast("int"))


def pairs(tokens: Column) -> Column:
    """Neighbouring tokens, joined by a space."""
    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, tokens[i + 1]))


def _blocks(n: Column) -> Column:
    return F.ceil(n / ROWS).cast("int")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key", "level", "block"), F.lit(buckets)).cast("int")


def _key_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TermIndex:
    """An index below ``path``; ``terms.lookup_terms`` and what builds on it take it in place of the synonyms."""

    spark: SparkSession
    path: str

    def finished(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    @cached_property
    def stats(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/stats").first()

    def lookup(self, terms: DataFrame, limit: int = 10, min_score: float = 0.0) -> DataFrame:
        """The rows of ``terms.lookup_terms`` over the indexed synonyms, from the blocks that can hold them.

        First come equal terms and, of each term's rarest token and pair, the best levels that hold ``limit`` rows.
        Their ``limit``-th score is the bar. A level of any other key is read only if its best contribution, with what
        the term's more frequent tokens can add, reaches the bar; this is exact.
        """
        from .terms import _ranked
        qw, levels, first = self._first(terms, limit, min_score)
        scored = first.unionByName(self._read(self._rest(levels, first, limit, min_score), qw, min_score))
        return _ranked(scored, limit).select("term", "rank", "score", "cui", "syn_term", "is_preferred", "semantic_types")

    def blocks_read(self, terms: DataFrame, limit: int = 10, min_score: float = 0.0) -> DataFrame:
        """(term, blocks_read, blocks_held): blocks that a lookup reads, and all blocks of the term's keys."""
        _, levels, first = self._first(terms, limit, min_score)
        read = levels.filter("first").unionByName(self._rest(levels, first, limit, min_score))
        held = levels.groupBy("term").agg(F.sum("blocks").alias("blocks_held"))
        return held.join(read.groupBy("term").agg(F.sum("blocks").alias("blocks_read")), "term")

    def _first(self, terms: DataFrame, limit: int, min_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The prepared terms, the levels of their keys and the scored rows of the levels that come first."""
        qw = self._prepared(terms)
        levels = cut(self._levels(qw, limit))
        return qw, levels, cut(self._read(levels.filter("first"), qw, min_score))

    def _rest(self, levels: DataFrame, first: DataFrame, limit: int, min_score: float) -> DataFrame:
        """Other levels that can reach the bar."""
        from .terms import _bars
        least = F.greatest(F.coalesce("bar", F.lit(min_score)), F.lit(min_score)) - 1e-9
        return cut(levels.filter(~F.col("first")).join(_bars(first, limit), "term", "left").filter(F.col("bound") >= least).drop("bar"))

    def _prepared(self, terms: DataFrame) -> DataFrame:
        """Distinct non-blank terms with tokens, weights of known tokens (best last), rarest pair and whole-term levels; stored."""
        from .terms import asked
        q = cut(asked(terms))
        key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
        keys = q.select("term", F.inline(once(F.concat(
            F.transform(F.array_distinct("q_tokens"), lambda t: key("t", t)),
            F.transform(F.array_distinct(pairs(F.col("q_tokens"))), lambda g: key("p", g)),
            F.array(key("e", F.col("q_lower"))))))).withColumn("bucket", _key_bucket(self.stats["buckets"]))
        known = keys.join(self._table("keys", keys), ["bucket", "kind", "key"])
        idf = F.ln(1 + (self.stats["rows"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.struct((idf * F.col("part")).alias("best"), idf.alias("idf"), F.col("key").alias("token"), "part", "levels")
        return cut(q.join(known.groupBy("term").agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "t", weight))).alias("weights"),
            F.min_by(F.when(F.col("kind") == "p", F.struct("key", "levels")), F.when(F.col("kind") == "p", F.struct("df", "key"))).alias("pair"),
            F.max(F.when(F.col("kind") == "e", F.col("levels"))).alias("whole")), "term", "left").withColumn(
                "weights", F.coalesce("weights", F.expr("array()").cast(_WEIGHTS))))

    def _levels(self, qw: DataFrame, limit: int) -> DataFrame:
        """(term, kind, key, place, level, blocks, bound, first): what a row of that level can score, exact matches apart.

        ``place`` is the token's among the weights. A row counts under its last weighted token, so nothing after it adds.
        """
        from .terms import BOOST_PHRASE
        one = F.when(F.size("q_tokens") == 1, BOOST_PHRASE).otherwise(0.0)
        below = lambda i: F.aggregate(F.slice("weights", F.lit(1), i), F.lit(0.0), lambda a, w: a + w["best"])

        def levels(kind, k, place, held, bound, tried):
            return F.transform(held, lambda v, j: F.struct(
                F.lit(kind).alias("kind"), k.alias("key"), place.alias("place"), v["level"].alias("level"), _blocks(v["n"]).alias("blocks"),
                bound(v).alias("bound"), (tried & (F.aggregate(F.slice(held, F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x["n"]) < limit)).alias("first")))

        last = F.size("weights") - 1
        tokens = F.flatten(F.transform("weights", lambda w, i: let(below(i) + one, lambda rest: levels(
            "t", w["token"], i, w["levels"], lambda v: w["idf"] * v["best"] + rest, i == last))))
        pair = levels("p", F.col("pair.key"), F.lit(-1), F.col("pair.levels"), lambda v: BOOST_PHRASE + F.aggregate(
            "weights", F.lit(0.0), lambda a, w: a + w["idf"] * F.least(w["part"], v["best"])), F.lit(True))
        held = F.coalesce("whole", F.expr("array(named_struct('level', 0, 'n', 1L, 'best', 0D))"))
        whole = F.transform(held, lambda v: F.struct(
            F.lit("e").alias("kind"), F.col("q_lower").alias("key"), F.lit(-1).alias("place"), v["level"].alias("level"),
            _blocks(v["n"]).alias("blocks"), F.lit(float("inf")).alias("bound"), F.lit(True).alias("first")))
        none = F.expr("array()").cast(_LEVELS)
        return qw.select("term", F.inline(once(F.concat(F.coalesce(tokens.cast(_LEVELS), none), F.coalesce(pair.cast(_LEVELS), none), whole.cast(_LEVELS)))))

    def _read(self, levels: DataFrame, qw: DataFrame, min_score: float) -> DataFrame:
        """Scored rows of the blocks of ``levels``; each row comes by one of its keys only."""
        from .terms import _phrase, _score
        wanted = levels.select("term", "kind", "key", "place", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn(
            "bucket", _bucket(self.stats["buckets"]))
        posted = self._table("postings", wanted)
        met = wanted.join(posted, ["bucket", "kind", "key", "level", "block"]).join(qw.select("term", "q_lower", "q_tokens", "weights"), "term")
        rows = met.select("term", "q_lower", "q_tokens", "weights", "kind", "place", F.inline(once(F.col("rows"))))
        equal, phrase = F.col("q_lower") == F.col("term_lower"), _phrase() & (F.size("q_tokens") > 1)
        later = F.exists(F.slice("weights", F.col("place") + 2, F.size("weights")), lambda w: F.array_contains("s_tokens", w["token"]))
        own = F.when(F.col("kind") == "e", equal).when(F.col("kind") == "p", ~equal & phrase).otherwise(~equal & ~phrase & ~later)
        return rows.filter(own).withColumn("score", _score(F.lit(self.stats["avgdl"]))).filter(F.col("score") > min_score).select(
            "term", "cui", "term_lower", "score", "syn_term", "is_preferred", "ord", "semantic_types")

    def _table(self, name: str, wanted: DataFrame) -> DataFrame:
        """A stored table, only the folders that ``wanted`` has rows for; their number is that of the folders at most."""
        used = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}").filter(F.col("bucket").isin(used))


_HELD = "array<struct<level:int,n:bigint,best:double>>"
_WEIGHTS = f"array<struct<best:double,idf:double,token:string,part:double,levels:{_HELD}>>"
_LEVELS = "array<struct<kind:string,key:string,place:int,level:int,blocks:int,bound:double,first:boolean>>"
_ROW = ("struct<cui:string,syn_term:string,term_lower:string,is_preferred:boolean,semantic_types:array<string>,ord:bigint,"
        "s_tokens:array<string>>")
_SCHEMAS = {"keys": f"kind string, key string, df bigint, part double, levels {_HELD}, bucket int",
            "postings": f"kind string, key string, level int, block int, rows array<{_ROW}>, bucket int"}

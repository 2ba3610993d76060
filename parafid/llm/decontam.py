"""Benchmark decontamination by winnowing.

Of every six neighbouring 5-grams the smallest hash is kept, so any ten words
shared with a benchmark item keep the same 5-gram on both sides. Kept hashes
are joined and each hit is extended word by word to its exact span.

Everything is a DataFrame expression. Fingerprints of the documents are first
held against a bit table of the benchmark's, 16 bits or more for each of them
and 2^24 at most, inside the row; only those that may occur leave it, each with the few words around it.
So the texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Store
from .registry import query, table

#: k-gram, window and the span they guarantee: GRAM + WINDOW - 1 words.
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
_POS = 30  # low bits of a packed hash hold the position
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of ``text``: A-Z lower-cased, runs without other ASCII than digits and letters; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), "")


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, from the words' hashes."""
    last = F.size(hashes) - n
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _packed(gram: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(gram, _POS), _POS).bitwiseOR(i.cast("long"))


def _winnowed(packed: Column) -> Column:
    """The smallest of each WINDOW neighbours, once; ties go to the first."""
    last = F.size(packed) - WINDOW
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.least(*[F.get(packed, i + j) for j in range(WINDOW)])))).otherwise(F.array().cast("array<bigint>"))


def _around(ws: Column, pos: Column) -> Column:
    """The words from WINDOW - 1 before ``pos`` to WINDOW - 1 behind its k-gram; null beyond the text."""
    return F.transform(F.sequence(pos - (WINDOW - 1), pos + SPAN - 1), lambda i: F.get(ws, i))


def _prepared(df: DataFrame) -> DataFrame:
    """Adds ``_h`` (hashes of ``_w``) and ``_sel`` (packed winnowed fingerprints)."""
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", _grams(F.col("_h"), GRAM))
    df = df.withColumn("_g", F.transform("_g", _packed))
    return df.withColumn("_sel", _winnowed(F.col("_g"))).drop("_g")


def _bit(fp: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(fp), F.lit(bits))


def _table_bits(prints: int) -> int:
    """A power of two with 16 bits for each print, 2^18 to 2^24; a fuller table lets more through, and loses nothing."""
    return 1 << min(max((16 * prints - 1).bit_length(), 18), 24)


def _bit_table(prints: DataFrame, bits: int) -> Column:
    """A constant array of ``bits`` / 64 longs that marks the fingerprints ``fp``; its size is all the driver holds."""
    marks = prints.select(_bit(F.col("fp"), bits).alias("_at")).select(
        F.shiftrightunsigned("_at", 6).alias("id"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("m"))
    words = [0] * (bits // 64)
    for r in marks.groupBy("id").agg(F.bit_or("m").alias("m")).collect():
        words[r.id] = r.m
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal


def _marked(marks: Column, fp: Column, bits: int) -> Column:
    at = _bit(fp, bits)
    return F.getbit(F.get(marks, F.shiftrightunsigned(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _equal_run(a: str, b: str, places) -> Column:
    """How many of ``places`` in turn hold equal words in the arrays ``a`` and ``b``, up to the first that differs."""
    out = F.lit(len(places))
    for n in reversed(range(len(places))):
        same = F.coalesce(F.get(a, F.lit(places[n])) == F.get(b, F.lit(places[n])), F.lit(False))
        out = F.when(same, out).otherwise(F.lit(n))
    return out


def find_hits(docs: DataFrame, items: DataFrame, *, bits: int | None = None, id_col: str = "doc_id", item_col: str = "item_id",
              text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents as (_row, id, n_words), hits as (_row, item, start, stop) in words.

    A hit is a run of document words that equals a run of item words and holds a
    whole window: SPAN words, or all words of an item that has fewer. ``bits`` of
    the bit table, a power of two, follow the number of fingerprints if not given.
    """
    spark = docs.sparkSession
    store = Store(spark, "decontam")
    i = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("_w")).filter("size(_w) > 0")
    long = store.keep(_prepared(i.filter(F.size("_w") >= SPAN)).select("item", "_w", "_sel"))
    long = long.select("item", "_w", F.explode("_sel").alias("s"))
    place = F.col("s").bitwiseAND(F.lit((1 << _POS) - 1)).cast("int")
    long = store.keep(long.select("item", F.shiftrightunsigned("s", _POS).alias("fp"), _around(F.col("_w"), place).alias("ctx"))
                      .distinct())
    short = store.keep(i.filter(F.size("_w") < SPAN).select("item", "_w", F.size("_w").alias("n")))
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # fewer than SPAN values
    short = short.withColumn("fp", F.xxhash64(F.lit(0), F.transform("_w", lambda w: F.xxhash64(w))))
    prints = store.keep(long.select("fp").union(short.select("fp")).distinct())
    bits = bits or _table_bits(prints.count())
    marks = _bit_table(prints, bits)

    d = _prepared(docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("_w")))
    pick = F.filter("_sel", lambda s: _marked(marks, F.shiftrightunsigned(s, _POS), bits))
    pick = F.transform(pick, lambda s: _candidate(F.shiftrightunsigned(s, _POS), s.bitwiseAND(F.lit((1 << _POS) - 1)).cast("int"),
                                                  F.lit(SPAN)))
    parts = [pick]
    parts += [_short_runs(n, marks, bits) for n in lengths]
    found = F.concat(*parts) if len(parts) > 1 else pick
    around = F.transform(found, lambda c: F.struct(
        c["fp"].alias("fp"), c["pos"].alias("pos"), c["n"].alias("n"),
        F.when(c["n"] == SPAN, _around(F.col("_w"), c["pos"])).otherwise(F.slice("_w", c["pos"] + 1, c["n"])).alias("ctx")))
    d = store.keep(d.select(F.monotonically_increasing_id().alias("_row"), "id", F.size("_w").cast("long").alias("n_words"), around.alias("c")))
    c = d.filter("size(c) > 0").select("_row", F.explode("c").alias("c")).select("_row", "c.fp", "c.pos", "c.n", "c.ctx")

    side = list(range(WINDOW - 1))
    j = c.filter(F.col("n") == SPAN).join(long.select("fp", "item", F.col("ctx").alias("ctx2")), "fp")
    j = j.filter(F.slice("ctx", WINDOW, GRAM) == F.slice("ctx2", WINDOW, GRAM))
    j = j.withColumn("l", _equal_run("ctx", "ctx2", side[::-1]))
    j = j.withColumn("r", _equal_run("ctx", "ctx2", [WINDOW - 1 + GRAM + x for x in side]))
    hits = j.filter(F.col("l") + F.col("r") >= WINDOW - 1).select(
        "_row", "item", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + GRAM + F.col("r")).alias("stop"))
    if lengths:
        j = c.filter(F.col("n") < SPAN).join(short.select("fp", "n", "item", "_w"), ["fp", "n"]).filter("ctx = _w")
        hits = hits.union(j.select("_row", "item", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("stop")))
    return d.drop("c"), store.keep(hits)


def _short_runs(n: int, marks: Column, bits: int) -> Column:
    """Candidates among all runs of ``n`` words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0)))
    runs = F.transform(starts, lambda k: _candidate(F.xxhash64(F.lit(0), F.slice("_h", k + 1, n)), k, F.lit(n)))
    return F.filter(runs, lambda c: (c["pos"] + n <= F.size("_w")) & _marked(marks, c["fp"], bits))


def _candidate(fp: Column, pos: Column, n: Column) -> Column:
    return F.struct(fp.alias("fp"), pos.alias("pos"), n.alias("n"))


def decontaminate(docs: DataFrame, items: DataFrame, *, bits: int | None = None, id_col: str = "doc_id",
                  item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    ``n_hit`` counts words inside an occurrence of any window, each once;
    ``items_sha256`` is the digest of the ids of the items found, sorted as
    strings and comma-joined.

    Null or wordless texts have no words and no hits; items without words match
    nothing, and an item without an id hits like any other but is not counted or named. Rows that repeat an id, on either side, count
    by themselves (an item id is named once). Empty tables give no rows, or no
    hits. Columns other than the named ones are not read, and a text of a
    billion words or more is beyond what a position holds.
    """
    d, hits = find_hits(docs, items, bits=bits, id_col=id_col, item_col=item_col, text_col=text_col)
    runs = hits.groupBy("_row", "start").agg(F.max("stop").alias("stop"))
    ahead = W.partitionBy("_row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.max("stop").over(ahead), F.lit(0))
    runs = runs.withColumn("n", F.greatest(F.col("stop") - F.greatest("start", done), F.lit(0)))
    n_hit = runs.groupBy("_row").agg(F.sum("n").cast("long").alias("n_hit"))
    names = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("names"))
    out = d.join(n_hit.join(names, "_row"), "_row", "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_words", n.alias("n_hit"),
                      F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
                      (n > 0).alias("contaminated"))


_ORACLE = r"""
with d as materialized (select doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') as w from documents),
b as materialized (select item_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'') as w from benchmark),
g as (select item_id, w, unnest(range(1, greatest(len(w)-9,1)+1)) as j from b where len(w)>0),
i as materialized (select distinct item_id, least(len(w),10) as n, array_to_string(w[j:j+9],' ') as k from g),
l as (select distinct n from i),
p as (select doc_id, n, w, unnest(range(1, len(w)-n+2)) as s from d, l where len(w)>=n),
h as materialized (select doc_id, s, p.n, item_id from p join i on i.n=p.n and i.k=array_to_string(w[s:s+p.n-1],' ')),
t as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(s, s+n)) as x from h) group by 1),
u as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as a from h group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit,0)::bigint as n_hit, coalesce(n_items,0)::bigint as n_items,
  sha256(coalesce(a,'')) as items_sha256, coalesce(n_hit,0)>0 as contaminated from d left join t using (doc_id) left join u using (doc_id)
"""


@query("op5_decontamination", _ORACLE)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

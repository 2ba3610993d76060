"""From raw `documents` to a weighted training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of `documents`; the last returns the mix. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parafid.llm import decontam, langid, markov, mixing, overlap
from parafid.llm.common import Store, small_batches
from parafid.llm.registry import table

#: A document is rejected when its main language labels less than this share of its letters.
LEAST_SCORE = 0.5
#: Keys of 64 characters that go to every task at most.
FEW = 100_000


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but the text as one struct, so that columns of any name pass through an operator."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from ``row`` and ``text``, but for those that ``changed`` gives by name."""
    return rows.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("text").alias(c) if c == "text"
                         else F.col("row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; ``lang`` becomes the one found.

    Null texts, texts without letters and texts without a main language go. Ids may be null or repeat; other columns
    may have any name.
    """
    small_batches(spark)
    found = langid.identify(_packed(docs), langid.train(docs), id_cols=("row",), with_text=True)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _unpacked(kept, docs, lang=F.col("lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, those without one last.

    Near copies have a Jaccard similarity of 0.8 or more between their five-word shingles, or are linked by such pairs.
    Each row is a document of its own: unlike texts may share an id, and other columns may have any name.
    """
    return overlap.without_copies(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; equal texts share the decision, whatever their ids."""
    keyed = _packed(docs).withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select("key", "text")
    bad = decontam.decontaminate(texts, table(spark, sf_dir, "benchmark"), id_col="key").filter("contaminated")
    keys = Store(spark, "contaminated").keep(bad.select("key").distinct())
    keys = F.broadcast(keys) if keys.count() <= FEW else keys  # more of them are joined by their hash
    return _unpacked(keyed.join(keys, "key", "left_anti"), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced in the text; ``n_chars`` follows. Ids may be null or repeat."""
    clean = markov.scan(_packed(docs), id_col="row", with_text=True).select("row", F.col("clean_text").alias("text"))
    return _unpacked(clean, docs, n_chars=F.length("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with what it takes of each; those it takes nothing of go."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", clean_of_benchmarks),
          ("secret scan", without_secrets), ("mixing sources", mix)]

#: Language models, shingle sets and Markov models are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), Store(spark, "pipeline")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs

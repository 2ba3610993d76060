"""Writers and small table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_stats_csv(df: DataFrame, path: str) -> bool:
    """CSV with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_text(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", *, folders: bool = True,
               rows_per_file: int = 100_000) -> None:
    """Texts under one folder per key value, line breaks inside a text kept.

    For very many keys take ``folders=False``: rows of key and text as JSON
    lines in files of ``rows_per_file`` at most.
    """
    rows = df.select(key, F.col(text).alias("value"))
    if folders:
        rows.write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)
    else:
        rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def truncate_texts(df: DataFrame, cols=("original_text", "simplified_text", "reference_text"), n: int = 500) -> DataFrame:
    return df.withColumns({c: truncate(F.col(c), n) for c in cols if c in df.columns})


def write_terminology(concepts: DataFrame, synonyms: DataFrame, path: str, buckets: int = 64,
                      table_prefix: str | None = None, force: bool = True, index: bool = False) -> DataFrame:
    """Write both tables and return for each its name, written ``rows`` and ``failed`` rows.

    A concept without a ``cui``, and a synonym without one or without a term, fails and is not written. With ``index``
    the synonyms' inverted index is written below ``path/index`` for ``lookup_terms``: read it as
    ``TermIndex(spark, path + "/index")``.

    With ``table_prefix`` the synonyms become a table bucketed by ``term_lower``
    and the concepts one bucketed by ``cui``, so lookups join without shuffling
    the terminology; otherwise plain parquet below ``path``.
    """
    spark = concepts.sparkSession
    mode = "overwrite" if force else "ignore"
    from ..operators.postings import write_index
    from ..operators.terms import table_counts
    lacks = lambda df: reduce(lambda a, c: a | F.col(c).isNull(), [c for c in ("cui", "term", "term_lower") if c in df.columns], F.lit(False))
    failed = concepts.filter(lacks(concepts)).agg(F.lit("concepts").alias("table"), F.count(F.lit(1)).alias("failed")).unionByName(
        synonyms.filter(lacks(synonyms)).agg(F.lit("synonyms").alias("table"), F.count(F.lit(1)).alias("failed")))
    concepts, synonyms = concepts.filter(~lacks(concepts)), synonyms.filter(~lacks(synonyms))
    if table_prefix:
        for df, name, key in ((concepts, "concepts", "cui"), (synonyms, "synonyms", "term_lower")):
            # a bucket is written by one task, so there is one file for each
            df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{name}").saveAsTable(
                f"{table_prefix}_{name}")
        read = lambda n: spark.table(f"{table_prefix}_{n}")
    else:
        concepts.write.mode(mode).parquet(f"{path}/concepts")
        synonyms.write.mode(mode).parquet(f"{path}/synonyms")
        read = lambda n: spark.read.parquet(f"{path}/{n}")
    if index:
        write_index(read("synonyms"), f"{path}/index", buckets, force)
    return table_counts(concepts=read("concepts"), synonyms=read("synonyms")).join(failed, "table")


# ----------------------------------------------------------------- history
def history_save(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Append documents (id, date, file_name, summary, original, simplified) with ``_saved``, the time of the call."""
    docs.withColumn("_saved", F.current_timestamp()).write.mode("append").parquet(path)


def _deleted(path: str) -> str:
    return path.rstrip("/") + "_deleted"


def history_remove(spark: SparkSession, ids: DataFrame, path: str) -> None:
    """Delete the documents ``ids`` (id) from the history below ``path``, lastingly.

    Ids and the time of the call are appended beside the rows, so nothing is rewritten and rows that others
    append meanwhile stay. A document saved again later is there again. Null ids delete nothing.
    """
    ids.select("id").filter("id is not null").distinct().withColumn("_until", F.current_timestamp()).write.mode("append").parquet(_deleted(path))


def history_read(spark: SparkSession, path: str) -> DataFrame:
    """The documents below ``path`` that no ``history_remove`` behind their saving has named."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    saved = F.col("_saved") if "_saved" in rows.columns else F.lit(None).cast("timestamp")
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_deleted(path))
    if not marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marks):
        return rows.drop("_saved")
    gone = spark.read.parquet(_deleted(path)).groupBy("id").agg(F.max("_until").alias("_until"))
    kept = rows.withColumn("_saved", saved).join(gone, "id", "left").filter("_until is null or _saved > _until")
    return kept.select(*[c for c in rows.columns if c != "_saved"])


def history_list(history: DataFrame) -> DataFrame:
    """Newest first (a global sort for display)."""
    return history.orderBy(F.desc("date"), F.desc("id"))


def history_get(history: DataFrame, doc_id) -> DataFrame:
    return history.filter(F.col("id") == doc_id)


def history_delete(history: DataFrame, doc_id) -> DataFrame:
    return history.filter(F.col("id") != doc_id)


def format_date(c: Column, short: bool = False) -> Column:
    return F.date_format(c, "MMM d, yyyy" if short else "MMMM d, yyyy 'at' hh:mm a")


def write_training_pairs(df: DataFrame, path: str) -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)

"""Helpers shared by the operators: stored tables, batches, spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local master without the setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Store:
    """Tables written to a run's own folder below ``shared_dir`` and read again.

    A written table cuts lineage: a lost executor repeats single tasks of the
    step at hand, never the steps before it. ``drop`` removes a table that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def drop(self, *numbers: int) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of whole texts go to Python workers in batches of ``rows`` at most, which bounds what a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def hash_key(*cols: str) -> Column:
    return F.xxhash64(*cols)


def white_words(text: Column) -> Column:
    """Number of words between white bytes; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def by_size(items: Iterable, size_of, limit: int) -> Iterator[list]:
    """Runs of consecutive items whose sizes add up to ``limit`` at most; a larger item stands alone."""
    run, total = [], 0
    for x in items:
        n = size_of(x)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run

"""Cutting lineage with reliable checkpoints, and steps that outlive their application."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir``, which every executor must reach.

    Only a local master without the setting gets a folder of its own; a cluster without it
    is an error, because rounds would silently be computed again for each action.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint below ``path`` (else ``checkpoint_dir``).

    Spark removes the files when the result is no longer referenced, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if path is not None or not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path or checkpoint_dir(df.sparkSession))
    return df.checkpoint()


class Steps:
    """Finished steps of a job, stored below ``path``, a folder that all executors share.

    A step counts as finished when Spark has committed its table, so an application that dies
    in the middle of one leaves nothing that a later one takes for whole. An application that
    is given the same folder reads finished steps and goes on behind them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def finished(self, name: str) -> bool:
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table ``name``; ``build()`` is called and written only if it is not finished."""
        if not self.finished(name):
            build().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def claim(self, df: DataFrame) -> None:
        """Note the rows that the steps start from; a folder that was begun with other rows is an error.

        Rows are compared as a set with repeats, by number and sum of hashes, in one scan.
        """
        row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
        facts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))
        facts = facts.withColumn("columns", F.lit(",".join(df.columns)))
        now = facts.first()
        if self.keep("input", lambda: self.spark.createDataFrame([now], facts.schema)).first() != now:
            raise ValueError(f"{self.path} holds steps of other rows")

"""Streaming variants.

The row-wise gates and evaluators are stateless and run on a streaming
DataFrame as they are; here are the one windowed aggregate and the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import exact_round


def ops_windowed(runs: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours",
                 group=("event_type",)) -> DataFrame:
    """Run metrics per window and group; approximate percentiles keep the state small.

    The watermark bounds the state and lets append mode emit closed windows.
    """
    # event time must be a zoned timestamp to carry a watermark
    g = runs.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if runs.isStreaming else runs
    return g.groupBy(F.window(ts, width), *group).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("latency_ms").alias("latency_mean_ms"),
        F.percentile_approx("latency_ms", [0.5, 0.95], 1000).alias("_p"),
        F.avg(F.col("first_pass_success").cast("int")).alias("first_pass_success_rate")).select(
        F.col("window.start").alias("window_start"), *group, "runs",
        exact_round(F.col("latency_mean_ms"), 2).alias("latency_mean_ms"), F.col("_p")[0].alias("latency_p50_ms"),
        F.col("_p")[1].alias("latency_p95_ms"), exact_round(F.col("first_pass_success_rate"), 4).alias("first_pass_success_rate"))


def append_runs(runs: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append run rows to a parquet table, exactly once per input row."""
    w = runs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).outputMode("append").start()

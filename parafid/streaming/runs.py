"""Runs put together from their events: a start, counters, a finish.

The events of a run are a session: they are folded per key before and after the
shuffle, in a batch as in a stream, and no run's events are held as a list. In a
stream the session is the state; the watermark closes it ``timeout`` after its
last event, so a run whose finish is lost goes out as well, and each run goes
out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "retry_count", "refinement_count")


def runs_from_events(events: DataFrame, *, key: str = "run_id", timeout: str = "1 hour", late: str = "2 hours",
                     unique: str | None = None) -> DataFrame:
    """Run rows (``evaluate.RUN_FIELDS``) with key, ``started``, ``finished`` and ``status``.

    ``events``: key, ``ts``, ``kind`` (start, counter, finish), ``name`` and ``value`` of a counter. Events of a key that
    are less than ``timeout`` apart are one run; an id that comes back later is another. Of several starts the first
    counts, of several finishes the last. ``status`` is ``finished``, ``open`` (no finish behind the start) or ``no_start``;
    only finished runs have a latency, which ``evaluate.ops_metrics`` takes as it is. Counters add up, missing
    values count 0, and a run without retries and refinements is a first-pass success.

    In a stream events later than ``late`` behind the newest are left out. Events that repeat a value of the column
    ``unique`` count once. Events without key or time are left out; other kinds and names only hold a run open.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    if unique:
        e = e.dropDuplicatesWithinWatermark([unique]) if events.isStreaming else e.dropDuplicates([unique])

    def at(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("ts"))

    def total(name: str) -> Column:
        own = (F.col("kind") == "counter") & (F.col("name") == name)
        return F.coalesce(F.sum(F.when(own, F.col("value").cast("double"))), F.lit(0.0)).cast("long").alias(name)

    runs = e.groupBy(F.session_window("ts", timeout).alias("session"), F.col(key)).agg(
        F.min(at("start")).alias("started"), F.max(at("finish")).alias("finished"), *[total(c) for c in COUNTERS])
    done = F.col("finished") >= F.col("started")
    latency = F.when(done, (F.unix_micros("finished") - F.unix_micros("started")) / 1000.0)
    status = F.when(F.col("started").isNull(), "no_start").when(done, "finished").otherwise("open")
    return runs.select(F.col(key), "started", "finished", status.alias("status"), latency.alias("latency_ms"), *COUNTERS,
                       ((F.col("retry_count") == 0) & (F.col("refinement_count") == 0)).alias("first_pass_success"))

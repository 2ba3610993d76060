"""Runs out of events, rounds that resume, header rules as tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parafid.operators import evaluate, sections
from parafid.plans.checkpoints import Steps
from parafid.plans.loop import iterate_until_valid, legacy_fix_loop
from parafid.plans.process import process_reports
from parafid.streaming.runs import runs_from_events

EVENTS = "event_id long, run_id string, ts timestamp, kind string, name string, value double"
T0 = datetime(2024, 1, 1)


def event(n, run, minutes, kind, name=None, value=None):
    return n, run, T0 + timedelta(minutes=minutes), kind, name, value


FIRST = [event(1, "a", 0, "start"), event(2, "a", 5, "counter", "input_tokens", 7.0), event(3, "b", 6, "start"),
         event(2, "a", 5, "counter", "input_tokens", 7.0), event(20, None, 6, "start")]
SECOND = [event(4, "a", 20, "finish"), event(5, "a", 10, "counter", "retry_count", 1.0), event(6, "c", 30, "finish"),
          event(7, "b", 40, "counter", "unknown", 3.0)]
LATER = [event(8, "d", 600, "start"), event(9, "d", 601, "finish"), event(10, "b", 602, "start")]
LATE = [event(11, "a", 21, "counter", "input_tokens", 100.0), event(12, "e", 2000, "start")]


def plain(rows):
    return sorted((r.run_id, r.status, r.latency_ms, r.input_tokens, r.retry_count, r.first_pass_success) for r in rows)


CLOSED = [("a", "finished", 1200000.0, 7, 1, False), ("b", "open", None, 0, 0, True), ("c", "no_start", None, 0, 0, True)]
CLOSED_LATER = [("b", "open", None, 0, 0, True), ("d", "finished", 60000.0, 0, 0, True)]


def test_runs_in_a_batch(spark):
    e = spark.createDataFrame(FIRST + SECOND + LATER, EVENTS)
    got = runs_from_events(e, unique="event_id")
    assert plain(got.collect()) == sorted(CLOSED + CLOSED_LATER, key=lambda r: (r[0], r[1], r[2] or 0))
    m = evaluate.ops_metrics(got).first()
    assert (m["runs"], m["latency_mean_ms"]) == (5, 630000.0)  # runs without a latency count in rates only
    assert runs_from_events(e.limit(0)).count() == 0


def test_runs_in_a_stream(spark, tmp_path):
    """Late events are left out, lost finishes time out, each run goes out once."""
    src, seen = str(tmp_path / "in"), []

    def go():
        e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        q = runs_from_events(e, unique="event_id", late="2 hours").writeStream.outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(
                lambda df, n: seen.extend(df.collect())).start()
        q.awaitTermination()

    for rows in (FIRST, SECOND):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        go()
    assert seen == []
    spark.createDataFrame(LATER, EVENTS).coalesce(1).write.mode("append").parquet(src)
    go()
    assert plain(seen) == CLOSED
    spark.createDataFrame(LATE, EVENTS).coalesce(1).write.mode("append").parquet(src)
    go()  # a new query on the old state, as after a crash
    assert plain(seen) == sorted(CLOSED + CLOSED_LATER, key=lambda r: (r[0], r[1], r[2] or 0))


def generator(spark, folder, bomb):
    """A text generator that notes each text it makes, and dies at texts already repaired while ``bomb`` is there."""
    @F.udf("string")
    def rewrite(key, text):
        import os
        import uuid
        if text.endswith("+") and os.path.exists(bomb):
            raise RuntimeError("lost")
        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write(f"{key}:{text.count('+')}")
        return text + "+"
    return rewrite


PAIRS = [(i, f"Dose {i} mg was given to the patient on the left side today here.", "no number at all") for i in range(10, 16)]


@pytest.mark.parametrize("legacy", [False, True])
def test_rounds_resume_after_a_crash(spark, tmp_path, legacy):
    made, bomb, folder = tmp_path / "made", tmp_path / "bomb", str(tmp_path / "rounds")
    made.mkdir()
    bomb.touch()
    rewrite = generator(spark, str(made), str(bomb))
    df = spark.createDataFrame(PAIRS, "pair_id int, original string, simplified string")

    def go(d=df):
        repair = lambda x: rewrite(F.col("pair_id"), F.col("simplified"))
        out = legacy_fix_loop(d, repair, 2, resume=folder) if legacy else iterate_until_valid(d, repair, 3, safety=False, resume=folder)
        return {r.pair_id: (r.iteration, r.simplified) for r in out.collect()}

    with pytest.raises(Exception, match="lost"):
        go()
    notes = lambda: sorted(f.read_text() for f in made.iterdir())
    first = [f"{p[0]}:0" for p in PAIRS]
    assert notes() == first
    bomb.unlink()
    want = {p[0]: (2 if legacy else 3, p[2] + "++") for p in PAIRS}
    assert go() == want
    assert notes() == sorted(first + [f"{p[0]}:1" for p in PAIRS])
    assert go() == want and len(notes()) == 2 * len(PAIRS)  # all is stored
    with pytest.raises(ValueError):
        go(df.limit(3))


def test_half_written_steps_are_written_again(spark, tmp_path):
    steps = Steps(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "x").mkdir(parents=True)
    assert not steps.finished("x")
    assert steps.keep("x", lambda: spark.range(3)).count() == 3
    assert steps.keep("x", lambda: spark.range(9)).count() == 3


def test_reports_resume(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()
    rewrite = generator(spark, str(made), str(tmp_path / "none"))
    docs = spark.createDataFrame([(1, "PLAN: Take 5 mg aspirin each day.\nDIAGNOSIS: Left knee pain."), (2, "Take 7 mg.")], "doc_id int, text string")
    go = lambda: process_reports(docs, lambda c: rewrite(F.lit("g"), F.col("original")), lambda d: F.col("original"),
                                 safety=False, resume=str(tmp_path / "r")).reports.collect()
    first = go()
    n = len(list(made.iterdir()))
    assert sorted(map(str, go())) == sorted(map(str, first)) and len(list(made.iterdir())) == n == 3


def test_one_iteration_at_least(spark):
    df = spark.createDataFrame(PAIRS, "pair_id int, original string, simplified string")
    with pytest.raises(ValueError):
        iterate_until_valid(df, lambda d: F.col("original"), 0)


def test_header_rules_from_a_table(spark):
    table = spark.createDataFrame([("de", 2, "^BEFUND:", None), ("de", 1, "^plan:", "i"), (None, 1, "x", None), ("de", 3, None, None)],
                                  "pack string, ord int, pattern string, flags string")
    assert sections.read_packs(table) == {"de": [("^plan:", "i"), ("^BEFUND:", "")]}
    with pytest.raises(ValueError):
        sections.read_packs(table, most=1)
    text = "vorn\nBefund: gut\nPLAN: ruhen\nweiter"
    df = spark.createDataFrame([(1, "de", text), (2, None, text), (3, "other", text), (4, "de", None)], "doc_id int, pack string, text string")
    got = [(r.doc_id, r.title, r.content) for r in sections.chunk_by_section(df, packs=table).orderBy("doc_id", "chunk_index").collect()]
    lead = [(None, "vorn\nBefund: gut"), ("PLAN", "ruhen\nweiter")]
    assert got == [(1, None, "vorn"), (1, "BEFUND", "gut"), (1, "PLAN", "ruhen\nweiter"), *((i, *x) for i in (2, 3) for x in lead)]
    assert [r.content for r in sections.chunk_by_section(df.limit(1), headers=()).collect()] == [text]

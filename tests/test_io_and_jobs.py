"""Readers, writers, loops and streams on temporary folders."""

import pytest
from pyspark.sql import functions as F

from parafid.functions import rules
from parafid.operators import evaluate, terms, validate
from parafid.plans.loop import iterate_until_valid, legacy_fix_loop
from parafid.sources import readers, writers
from parafid.streaming.ops import append_runs, ops_windowed


def test_read_reports_gates(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve text".encode())
    (tmp_path / "b.txt").write_bytes("na\xefve".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"   ")
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"x" * (rules.MAX_TXT_BYTES + 1))
    got = {r.path[-5:]: (r.text, r.reject_reason) for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("naïve text", None) and got["b.txt"] == ("naïve", None)
    assert got["c.txt"][1] == "file is empty" and got["d.doc"][1] == "invalid file type"
    assert got["e.txt"] == (None, "file too large")


def test_samples_json_both_shapes(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"sample_id": "1", "original_text": "a", "simplified_text": "b"}]')
    (tmp_path / "d.json").write_text('{"samples": [{"sample_id": "2", "original_text": "c", "simplified_text": "d"}]}')
    (tmp_path / "x.json").write_text('{"other": 1}')
    assert readers.read_samples_json(spark, str(tmp_path / "l.json")).first().sample_id == "1"
    assert readers.read_samples_json(spark, str(tmp_path / "d.json")).first().sample_id == "2"
    with pytest.raises(Exception, match="Unknown JSON format"):
        readers.read_samples_json(spark, str(tmp_path / "x.json")).collect()


def test_pair_csv_with_bom_and_filters(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('﻿index,original_text,plain_language_text,source_dataset,split\n1,"a ""q""\nline",b,S1,Train\n2,,x,S1,train\n3,c,d,S2,test\n', encoding="utf-8")
    rows = readers.read_pair_dataset(spark, str(p), split="train").collect()
    assert [(r.sample_id, r.original_text) for r in rows] == [("1", 'a "q"\nline')]


def test_rrf_order_and_padding(spark, tmp_path):
    p = tmp_path / "M.RRF"
    p.write_text("A|B|C||\n\nD|\n")
    rows = readers.read_rrf(spark, str(p), ["x", "y", "z"]).orderBy("ord").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [("A", "B", "C"), ("D", "", "")]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.write_stats_csv(df, str(tmp_path / "c")) and not writers.write_stats_csv(df.limit(0), str(tmp_path / "n"))
    writers.write_text(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).select("value").collect()) == ["a", "b"]


def test_terminology_round_trip(spark, tmp_path):
    rows = [("C1", "ENG", "P", "Y", "SRC", "PT", "Heart Attack", "N", 1), ("C1", "ENG", "S", "N", "SRC", "SY", "heart attack", "N", 2),
            ("C2", "ENG", "P", "Y", "SRC", "PT", "Stroke", "N", 3), ("C2", "ENG", "P", "Y", "SRC", "PT", "Old", "Y", 4)]
    conso = spark.createDataFrame(rows, "CUI string, LAT string, TS string, ISPREF string, SAB string, TTY string, STR string, SUPPRESS string, ord int")
    concepts, synonyms = terms.build_concepts(conso), terms.build_synonyms(conso)
    counts = {r.table: r.rows for r in writers.write_terminology(concepts, synonyms, str(tmp_path)).collect()}
    assert counts == {"concepts": 2, "synonyms": 2}
    q = spark.createDataFrame([("HEART attack",), ("unknown",), (" ",)], "term string")
    got = {r.term: r.preferred_term for r in terms.canonical_of(q, synonyms, concepts).collect()}
    assert got["HEART attack"] == "Heart Attack" and got["unknown"] is None


def test_lookup_on_a_hot_token_equals_full_scoring(spark):
    """A token in most synonyms is skipped for candidates, yet results equal the unpruned lookup."""
    syn = [(f"C{i}", f"disease kind{i}", f"disease kind{i}", True, [], i) for i in range(300)] + [("X", "disease", "disease", True, [], 999)]
    s = spark.createDataFrame(syn, "cui string, term string, term_lower string, is_preferred boolean, semantic_types array<string>, ord int")
    q = spark.createDataFrame([("disease",), ("kind7 disease",), ("the disease kind9",)], "term string")
    key = lambda df: sorted((r.term, r.cui, round(r.score, 6)) for r in df.collect())
    assert key(terms.lookup_terms(q, s, 1000, 5.0)) == key(terms.lookup_terms(q, s, 1000).filter("score > 5"))


def test_ops_percentiles_on_one_hot_group(spark):
    vals = [((i * 7919) % 5000) / 10 for i in range(30000)]
    df = spark.createDataFrame([(v,) for v in vals], "latency_ms double")
    m = evaluate.ops_metrics(evaluate.record_runs(df)).first()
    s, n = sorted(vals), len(vals)
    assert m.latency_p50_ms == round(s[int(n * .5)], 2) and m.latency_p95_ms == round(s[min(int(n * .95), n - 1)], 2)


def test_loop_keeps_every_row_and_flags_reviews(spark):
    t = "Dose 5 mg was given to the patient on the left side today here."
    df = spark.createDataFrame([(1, t, t), (2, t, "x" * 60), (3, t, "short")], "pair_id int, original string, simplified string")
    out = iterate_until_valid(df, lambda d: F.when(F.col("pair_id") == 2, F.col("original")).otherwise(F.col("simplified")), 3, safety=False)
    assert {r.pair_id: (r.iteration, r.needs_review) for r in out.collect()} == {1: (1, False), 2: (2, False), 3: (3, True)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    cols = ["ts", "event_type", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("first_pass_success")]
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(*cols).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = ops_windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.window_start, r.event_type, r.runs, r.latency_mean_ms) for r in df.collect())
    assert key(spark.table("w")) == key(ops_windowed(batch))
    append_runs(stream.select("event_type", "latency_ms"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_sample_is_reproducible_and_whole_when_small(spark):
    df = spark.range(500).withColumnRenamed("id", "sample_id")
    ids = lambda d: sorted(r.sample_id for r in d.collect())
    a = ids(readers.sample_n(df, 20, 1))
    assert len(set(a)) == 20 and a == ids(readers.sample_n(df.repartition(7), 20, 1)) != ids(readers.sample_n(df, 20, 2))
    assert ids(readers.sample_n(df, 0)) == ids(readers.sample_n(df, 900)) == list(range(500))


def test_process_reports_end_to_end(spark):
    from parafid.plans.process import process_reports
    text = "Plan: rest for the patient at home with plenty of fluids and sleep.\nLABS: Dose 5 mg was given on the left side of the patient today."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    lost = "Nothing of note is said in this rewritten text about any dose at all."
    chunks, whole, glossary, sources = process_reports(
        docs, lambda c: F.when(F.col("title") == "LABS", lost).otherwise(F.col("original")), lambda c: F.col("original"), safety=False)
    got = {r.chunk_index: (r.iteration, r.similarity, r.needs_review) for r in chunks.collect()}
    assert got == {0: (1, 1.0, False), 1: (2, 1.0, False)}
    row = whole.first()
    assert row.chunks == 2 and row.simplified_text == row.original_text and lost not in row.simplified_text
    assert glossary.count() > 0 and sources.count() == 0


def test_process_reports_keywords_and_citations(spark):
    """A generator that also gives keywords and citations: the keyword loop runs first, citations merge over chunks."""
    from parafid.plans.process import process_reports
    text = "Plan: rest for the patient at home with plenty of fluids and sleep.\nLABS: Dose 5 mg of aspirin was given to the patient today."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    cite = F.when(F.col("title") == "LABS", F.create_map(F.lit("Guide"), F.array(F.lit("p2")), F.lit("Atlas"), F.array(F.lit("p3")))).otherwise(
        F.create_map(F.lit("Guide"), F.array(F.lit("p1"))))
    lost = F.when(F.col("title") == "LABS", "The patient was given some dose of a drug today at the ward.").otherwise(F.col("original"))
    sources = spark.createDataFrame([(1, "Guide", 1, "http://g", "G"), (1, "Guide", 2, "http://late", "L"), (1, "Atlas", 3, "http://a", "A")],
                                    "doc_id int, title string, ord int, url string, summary string")
    done = process_reports(
        docs, lambda c: F.struct(lost.alias("text"), F.array(F.lit("patient")).alias("keywords"), cite.alias("citations")),
        lambda c: F.col("original"), keyword_repair=lambda c: F.col("original"), sources=sources, safety=False)
    got = {(r.doc_id, r.chunk_index): r for r in done.chunks.collect()}
    assert got[1, 0].keyword_iteration == 1 and got[1, 1].keyword_iteration == 2 and got[1, 1].iteration == 1
    report = {r.doc_id: r for r in done.reports.collect()}[1]
    assert report.citations == {"Guide": ["p1", "p2"], "Atlas": ["p3"]}
    assert [(r.title, r.citation_number, r.url) for r in done.sources.orderBy("citation_number").collect()] == [
        ("Guide", 1, "http://g"), ("Atlas", 2, "http://a")]


def test_loops_lose_no_rows(spark):
    rows = [(1, "Dose 5 mg today for the patient at home.", None), (2, None, "x"), (3, None, None), (4, "No stroke was seen.", "No stroke was seen.")]
    df = spark.createDataFrame(rows, "pair_id int, original string, simplified string")
    none = lambda d: F.lit(None).cast("string")
    for repair in (none, lambda d: F.col("original")):
        assert sorted(r.pair_id for r in iterate_until_valid(df, repair, 3).collect()) == [1, 2, 3, 4]
        assert sorted(r.pair_id for r in legacy_fix_loop(df, repair, 3).collect()) == [1, 2, 3, 4]


def test_null_rewrite_keeps_nothing(spark):
    df = spark.createDataFrame([(1, "Dose 5 mg. Blood pressure 120/80 mmHg with stroke.", None)], "pair_id int, original string, simplified string")
    v = validate.run_validators(df).first()
    assert v.recall == 0.0 and v.safety_review and not v.passed
    assert all(e is not None for e in v.results) and any(e.code == "EMPTY_CONTENT" for r in v.results for e in r.errors)


def test_supplied_errors_must_be_named(spark):
    df = spark.createDataFrame([(1, "a", "b")], "pair_id int, original string, simplified string")
    extra = spark.createDataFrame([(1, "mine", "X", {"k": "v"})], "pair_id int, validator string, code string, metadata map<string,string>")
    got = validate.error_rows(validate.run_validators(df, (), safety=False, extra_errors=extra, supplied=("mine",))).first()
    assert got.code == "X" and got.metadata == {"k": "v"}
    with pytest.raises(Exception, match="mine"):
        validate.run_validators(df, safety=False, extra_errors=extra).collect()


def test_no_caps_unless_asked(spark):
    pats = " ".join(f"Blood pressure {100 + i}/{60 + i} mmHg." for i in range(40))
    none = F.expr("cast(array() as array<struct<pos:int,phrase:string,cui:string,tuis:array<string>>>)")
    r = spark.createDataFrame([(pats,)], "t string").select(terms.rank_concepts(F.col("t"), none).alias("r"))
    n, block, whole = r.select(F.size("r"), terms.format_concepts(F.col("r")), terms.format_concepts(F.col("r"), None)).first()
    assert n > 15 and block.count("MUST INCLUDE") == 15 and whole.count("MUST INCLUDE") == n


def test_safety_block(spark):
    s = spark.range(1).select(validate.safety_block(F.struct(F.lit(0.25).alias("recall"), F.array(*[F.lit(f"c{i}") for i in range(12)]).alias("missing"))).alias("b"))
    b = s.first().b
    assert "0.25" in b and b.count("\n- ") == 10 and b.endswith("... and 2 more")


def test_ops_of_no_runs_and_of_many(spark):
    empty = spark.createDataFrame([], "latency_ms double, input_tokens int, output_tokens int, retry_count int, refinement_count int, first_pass_success boolean")
    assert tuple(evaluate.ops_metrics(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    runs = spark.range(5000).select(((F.col("id") * 7919) % 5000 / 3.0).alias("latency_ms"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"),
                                    F.lit(0).alias("retry_count"), F.lit(0).alias("refinement_count"), F.lit(True).alias("first_pass_success"))
    want = sorted(r.latency_ms for r in runs.collect())
    got = evaluate.ops_metrics(runs, accuracy=50, rows=10).first()
    assert got.latency_p50_ms == round(want[2500], 2) and got.latency_p95_ms == round(want[4750], 2)


def test_bare_object_is_no_sample_list(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"sample_id": "1", "original_text": "a", "simplified_text": "b"}')
    with pytest.raises(Exception, match="Unknown JSON format"):
        readers.read_samples_json(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "l.jsonl").write_text('{"sample_id": "1", "original_text": "a"}\n{"sample_id": "2"}\n')
    assert readers.read_samples_lines(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_pairs_without_index_are_numbered(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    for n in range(2):
        (folder / f"p{n}.csv").write_text("original_text,plain_language_text,source_dataset\n" + "".join(
            f"o{n}{i},{'' if i == 1 else 'r'},\n" for i in range(4)))
    rows = readers.read_pair_dataset(spark, str(folder)).collect()
    assert sorted((int(r.sample_id), r.original_text, r.source_dataset, r.split) for r in rows) == [
        (k, f"o{n}{i}", "", "unknown") for k, (n, i) in enumerate((n, i) for n in range(2) for i in (0, 2, 3))]


def test_rrf_parts_keep_their_order(spark, tmp_path):
    for n in (1, 0):
        (tmp_path / f"M{n}.RRF").write_text("".join(f"{n}{i}|x\n" for i in range(3)))
    rows = readers.read_rrf(spark, str(tmp_path), ["x", "y"]).orderBy("ord").collect()
    assert [r.x for r in rows] == ["00", "01", "02", "10", "11", "12"]


def test_bucketed_terminology_has_one_file_a_bucket(spark, tmp_path):
    c = spark.range(500).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("cui")).repartition(6)
    s = c.select("cui", F.lower("cui").alias("term_lower"))
    writers.write_terminology(c, s, str(tmp_path), buckets=4, table_prefix="t_one")
    assert len(list((tmp_path / "concepts").glob("part-*"))) <= 4 and len(list((tmp_path / "synonyms").glob("part-*"))) <= 4


def test_texts_in_bounded_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line\n{i}") for i in range(10)], "doc_id int, text string").coalesce(1)
    writers.write_text(df, str(tmp_path / "o"), folders=False, rows_per_file=3)
    assert len(list((tmp_path / "o").glob("part-*"))) == 4
    assert spark.read.json(str(tmp_path / "o")).filter("value = concat('line\n', doc_id)").count() == 10


def test_highlight_terms_are_literal(spark):
    from parafid.operators import report
    t = spark.createDataFrame([("a \\E b lung a\\Ec lung",)], "t string")
    got = t.select(report.highlight_spans(F.col("t"), F.array(F.lit(""), F.lit("a\\Ec"), F.lit("lung"))).alias("s")).first().s
    assert [(s.term, s.start) for s in got] == [("lung", 7), ("a\\Ec", 12), ("lung", 17)]


def test_lookup_makes_few_candidates_on_a_hot_token(spark):
    """A token in a twentieth of the synonyms makes no candidates for terms whose own token settles the match."""
    name = F.when(F.col("id") % 20 == 0, F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" disease"))).otherwise(
        F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(" sign")))
    syn = spark.range(20_000).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("cui"), name.alias("term"), F.lower(name).alias("term_lower"),
        F.lit(False).alias("is_preferred"), F.col("id").alias("ord"), F.expr("cast(array() as array<string>)").alias("semantic_types"))
    terms_ = spark.range(0, 4000, 20).select(F.concat(F.lit("chronic t"), F.col("id").cast("string"), F.lit(" disease")).alias("term"))
    q, s, qw, avgdl = terms._prepared(terms_, syn)
    first = terms._scored(terms._first_tier(q, s, qw), s, qw, avgdl)
    second = terms._second_tier(qw, s, terms._bars(first, 1), 0.0)
    assert first.count() == 200 and second.count() == 0
    got = {r.term: r.cui for r in terms.top_match(terms_, syn).collect()}
    assert got == {f"chronic t{i} disease": f"C{i}" for i in range(0, 4000, 20)}
    assert terms.lookup_terms(terms_.limit(3), syn, 10).count() == 30


def test_report_output_is_read_and_must_have_its_field(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"simplified_report": [{"original_chunk": "a", "simplified_chunk": null}, {"original_chunk": "b", "simplified_chunk": "c"}]}')
    (tmp_path / "x.json").write_text('{"other": 1}')
    rows = readers.output_samples(readers.read_report_output(spark, str(tmp_path / "r.json"))).collect()
    assert [(r.sample_id, r.original_text, r.simplified_text) for r in rows] == [("chunk_0", "a", ""), ("chunk_1", "b", "c")]
    with pytest.raises(Exception, match="simplified_report"):
        readers.read_report_output(spark, str(tmp_path / "x.json")).collect()


def test_history_and_training_files(spark, tmp_path):
    h = spark.createDataFrame([(1, "2024-01-02 15:04:05")], "id int, date string").withColumn("date", F.to_timestamp("date"))
    for _ in range(2):
        writers.history_save(spark, h, str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 2 and writers.history_delete(back, 1).count() == 0
    assert back.select(writers.format_date(F.col("date")), writers.format_date(F.col("date"), True)).first()[:] == (
        "January 2, 2024 at 03:04 PM", "Jan 2, 2024")
    pairs = spark.createDataFrame([("train", "a", "b"), ("test", "c", "d")], "split string, input_text string, target_text string")
    writers.write_training_pairs(pairs, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"split=train", "split=test"}


def test_history_deletes_last(spark, tmp_path):
    """Deleted documents are gone from what is stored; saved again they are back; rows without a time count as old."""
    path = str(tmp_path / "h")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    docs = lambda *n: ids(*n).withColumn("summary", F.concat(F.lit("s"), "id"))
    listed = lambda: sorted((r.id, r.summary) for r in writers.history_read(spark, path).collect())
    docs(1, 2).write.parquet(path)  # rows without the time of saving
    writers.history_save(spark, docs(3, 3, 4), path)
    assert [r[0] for r in listed()] == [1, 2, 3, 3, 4]
    writers.history_remove(spark, ids(1, 3, 3, 99, None), path)
    assert listed() == [(2, "s2"), (4, "s4")] and writers.history_read(spark, path).columns == ["id", "summary"]
    writers.history_save(spark, docs(3, 5), path)
    assert [r[0] for r in listed()] == [2, 3, 4, 5]
    writers.history_remove(spark, ids(), path)
    writers.history_remove(spark, ids(3), path)
    assert [r[0] for r in listed()] == [2, 4, 5]


def test_table_sizes(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "a"))
    row = terms.table_counts(sizes=True, a=spark.read.parquet(str(tmp_path / "a"))).first()
    assert (row.table, row.rows) == ("a", 100) and row.bytes > 100


def test_ops_metrics_ranks_and_odd_latencies(spark):
    """Ranks are exact for any accuracy, with ties; NaN and infinite latencies count as none."""
    import math
    import random

    rng = random.Random(11)
    for n, accuracy, ties in ((30_001, 10_000, False), (30_001, 100, False), (5000, 20, True), (12_000, 1000, True)):
        vals = [float(rng.randrange(40)) if ties else rng.random() * 1e6 for _ in range(n)]
        odd = [float("nan"), float("inf"), float("-inf"), None]
        df = spark.createDataFrame([(v, 1) for v in vals + odd], "v double, g int")
        got = evaluate.ops_metrics(evaluate.record_runs(df, "v", group=("g",)), ("g",), accuracy=accuracy, rows=1).first()
        vals.sort()
        assert got.runs == n + 4
        assert math.isclose(got.latency_p50_ms, vals[min(int(n * .5), n - 1)], abs_tol=.005 + 1e-9)
        assert math.isclose(got.latency_p95_ms, vals[min(int(n * .95), n - 1)], abs_tol=.005 + 1e-9)
    none = spark.createDataFrame([(float("nan"),)], "v double")
    assert tuple(evaluate.ops_metrics(evaluate.record_runs(none, "v")).first())[:4] == (1, 0.0, 0.0, 0.0)


def test_phrases_stay_in_their_row(spark, monkeypatch):
    """A bit table lets all phrases of the dictionary through and few others, and changes no result."""
    from parafid.operators import terms

    words = [f"w{i}" for i in range(3000)]
    d = spark.createDataFrame([(" ".join(words[i:i + 1 + i % 3]), f"v{i}") for i in range(0, 900, 9)], "phrase string, value string")
    known = terms.phrase_bits(d)
    assert d.filter(known(F.col("phrase"))).count() == d.count()
    others = spark.createDataFrame([(f"x{i}",) for i in range(2000)], "phrase string")
    assert others.filter(known(F.col("phrase"))).count() < 200
    texts = spark.createDataFrame([(k, words[k * 50:k * 50 + 120]) for k in range(20)], "doc_id long, w array<string>")
    got = sorted(map(str, terms.phrase_hits(texts, F.col("w"), d, 3).collect()))
    monkeypatch.setattr(terms, "MOST_BITS", 0)
    monkeypatch.setattr(terms.phrase_bits, "__defaults__", (0,))
    assert terms.phrase_bits(d) is None
    assert got == sorted(map(str, terms.phrase_hits(texts, F.col("w"), d, 3).collect())) and got


def test_highlight_thousands_of_terms(spark):
    """Spans equal those of the terms that occur, whatever else the list holds."""
    from parafid.operators import report
    text = "Aspirin and heart failure; HEART again, aspirins not. Term77x is none, term77 is."
    own = ["heart", "heart failure", "aspirin", "again"]
    terms = own + [f"term{i}" for i in range(5000)]
    df = spark.createDataFrame([(text, own + ["term77"], terms)], "text string, few array<string>, many array<string>")
    few, many = df.select(report.highlight_spans(F.col("text"), F.col("few")), report.highlight_spans(F.col("text"), F.col("many"))).first()
    assert few == many
    assert [(text[s.start:s.end], s.term) for s in many] == [("Aspirin", "aspirin"), ("heart failure", "heart failure"), ("HEART", "heart"),
                                                            ("again", "again"), ("term77", "term77")]


@pytest.mark.parametrize("least", [0.0, 0.1, 0.3, 0.6])
def test_best_match_equals_all_scores(spark, least):
    """Leaving out word sets that can't decide changes no match."""
    import random
    from parafid.operators import match
    rng = random.Random(8)
    drugs, words = ["aspirin", "ibuprofen", "metformin"], ["take", "the", "pill", "each", "day", "pain", "knee", "left", "old"]

    def sentence():
        return " ".join(rng.choices(words, k=rng.randint(3, 8)) + rng.choices(drugs, k=rng.randint(0, 2)) + [str(rng.randint(1, 4))] * rng.randint(0, 1))

    rows = [(i, [sentence() for _ in range(9)], [sentence() for _ in range(9)]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, o array<string>, s array<string>").select(
        "i", match.sentence_features(F.col("o")).alias("o"), match.sentence_features(F.col("s")).alias("s"))
    got = {(r.i, m.pos): (m.match_pos, round(m.score, 9)) for r in df.select("i", match.best_matches(F.col("o"), F.col("s"), least).alias("m")).collect()
           for m in r.m}

    def jaccard(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) & set(b) else 0.0

    n = 0
    for r in df.collect():
        for k, s in enumerate(r.s):
            scores = [0.35 * jaccard(s.drugs, o.drugs) + 0.25 * jaccard(s.numbers, o.numbers) + 0.25 * jaccard(s.entities, o.entities)
                      + 0.15 * jaccard(s.words, o.words) for o in r.o]
            best = max(scores)
            ok = best >= least and best > 0
            n += ok
            assert got[r.i, k][1] == pytest.approx(best if ok else 0.0, abs=1e-9)
            assert not ok and got[r.i, k][0] is None or scores[got[r.i, k][0]] == pytest.approx(best)
    assert n > 10

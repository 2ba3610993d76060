"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text", "sentences_expanded", "count_syllables", "readability", "dataset_stats",
    "extract_numbers", "extract_critical_typed", "detect_action_sentences", "extract_grounding_terms",
    "numeric_missing", "unit_mismatch", "concept_safety", "validation_summary", "best_sentence_match",
    "align_propositions", "build_concepts", "build_synonyms", "lookup_terms_threshold", "match_concepts",
    "coverage_measurements", "aggregate_dataset", "ops_metrics", "detect_sections", "build_glossary",
    "assemble_report", "highlight_spans",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("parafid-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("parafid.fixture.partitions", cpus)
             # call-site capture for every Column call makes building large expressions slow
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from parafid.plans import catalog

    counted: dict[str, int] = {}

    def rows_of(df) -> int:
        """Rows of the tables that a query reads."""
        for f in set(df.inputFiles()) - set(counted):
            counted[f] = spark.read.parquet(f).count()
        return sum(counted[f] for f in set(df.inputFiles()))

    catalog.QUERIES["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # session and classes
    times, speed = {}, {}
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        speed[name] = round(rows_of(df) / times[name])
        print(name, times[name], speed[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "input_rows_per_sec": speed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

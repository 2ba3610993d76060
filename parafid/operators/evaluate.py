"""Evaluators and dataset-level aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.readability import compare, readability, simple_readability
from ..functions.rx import let, literal_words
from ..functions.sets import exact_round, fuzzy_missing, ratio
from ..functions.text import word_count_ws
from ..plans.checkpoints import cut

EVALUATORS = ("readability", "simplification", "concept", "coverage")
CONCEPTS = "array<struct<cui:string,tuis:array<string>>>"


def _no_concepts() -> Column:
    return F.expr(f"cast(array() as {CONCEPTS})")


def cuis(concepts: Column) -> Column:
    return F.array_distinct(F.transform(concepts, lambda c: c["cui"]))


# ---------------------------------------------------------------- per sample
def simplification_quality(original: Column, simplified: Column, o_read: Column, s_read: Column,
                           o_cuis: Column, s_cuis: Column) -> Column:
    """Preservation rates, density, expansion and the overall score."""
    groups = tuple(extract.QUALITY_GROUPS)
    found = F.transform(F.array(original, simplified), extract.extract_quality_groups)  # one expression for the two sides

    def lost(x: Column) -> Column:
        return F.struct(*[F.struct(
            F.size(x[0][g]).alias("n"),
            F.array_sort(fuzzy_missing(x[0][g], x[1][g])).alias("miss")).alias(g) for g in groups])

    def build(m: Column) -> Column:
        n = sum((m[g]["n"] for g in groups), F.lit(0))
        kept = n - sum((F.size(m[g]["miss"]) for g in groups), F.lit(0))
        critical = ratio(kept, F.nullif(n, F.lit(0)), 1.0)
        meas = ratio(m["measurement"]["n"] - F.size(m["measurement"]["miss"]),
                     F.nullif(m["measurement"]["n"], F.lit(0)), 1.0)
        concept = ratio(F.size(F.array_intersect(o_cuis, s_cuis)), F.nullif(F.size(o_cuis), F.lit(0)), 1.0)
        ow, sw = o_read["word_count"], s_read["word_count"]
        gain = o_read["fkgl"] - s_read["fkgl"]
        bonus = F.when((sw > 0) & (gain > 0), F.least(F.lit(0.2), gain / 10)).otherwise(F.lit(0.0))
        return let(F.struct(critical.alias("c"), meas.alias("m"), concept.alias("r"), bonus.alias("b")), lambda v: F.struct(
            exact_round(v["r"], 4).alias("concept_recall"), exact_round(v["c"], 4).alias("critical_concept_recall"),
            exact_round(v["m"], 4).alias("measurement_preservation"),
            exact_round(ow / F.greatest(F.size(o_cuis), F.lit(1)), 2).alias("original_words_per_concept"),
            exact_round(sw / F.greatest(F.size(s_cuis), F.lit(1)), 2).alias("simplified_words_per_concept"),
            exact_round(ratio(sw, F.nullif(ow, F.lit(0)), 1.0), 2).alias("expansion_ratio"),
            *[m[g]["miss"].alias(f"missing_{name}") for g, name in (
                ("diagnosis", "diagnoses"), ("medication", "medications"), ("measurement", "measurements"))],
            exact_round(0.4 * v["c"] + 0.3 * v["r"] + 0.1 * v["m"] + 0.2 * v["b"], 4).alias("simplification_score")))

    return let(found, lambda x: let(lost(x), build))


def concept_overlap(orig: Column, simp: Column) -> Column:
    """CUI precision / recall / F1 and the type-weighted F1 (null when 0).

    Inputs are ``array<struct<cui,tuis>>`` with one entry per CUI.
    """
    important = literal_words(rules.WEIGHTED_TYPES)

    def weight(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, c: a + F.when(
            F.arrays_overlap(c["tuis"], important), rules.WEIGHT_HIGH).otherwise(1.0))

    def build(x: Column) -> Column:
        n = F.size(x["sh"])
        so = F.filter(x["o"], lambda c: F.array_contains(x["sh"], c["cui"]))
        ss = F.filter(x["s"], lambda c: F.array_contains(x["sh"], c["cui"]))
        nz = F.lit(0)
        parts = F.struct(
            ratio(n, F.nullif(F.size(x["s"]), nz), 0.0).alias("p"), ratio(n, F.nullif(F.size(x["o"]), nz), 0.0).alias("r"),
            ratio(weight(ss), F.nullif(weight(x["s"]), F.lit(0.0)), 0.0).alias("wp"),
            ratio(weight(so), F.nullif(weight(x["o"]), F.lit(0.0)), 0.0).alias("wr"), n.alias("n"),
            F.size(x["o"]).alias("no"), F.size(x["s"]).alias("ns"))
        return let(parts, finish)

    def f1(p: Column, r: Column) -> Column:
        return ratio(2 * p * r, F.nullif(p + r, F.lit(0.0)), 0.0)

    def finish(v: Column) -> Column:
        return F.struct(
            exact_round(v["p"], 4).alias("cui_precision"), exact_round(v["r"], 4).alias("cui_recall"),
            exact_round(f1(v["p"], v["r"]), 4).alias("cui_f1"), v["no"].alias("original_cui_count"),
            v["ns"].alias("simplified_cui_count"), v["n"].alias("shared_cui_count"),
            F.nullif(exact_round(f1(v["wp"], v["wr"]), 4), F.lit(0.0)).alias("semantic_type_weighted_f1"))

    return let(F.struct(orig.alias("o"), simp.alias("s"),
                        F.array_intersect(cuis(orig), cuis(simp)).alias("sh")), build)


def coverage(original: Column, simplified: Column, o_cuis: Column, s_cuis: Column) -> Column:
    """Source CUI recall and measurement preservation; 1 when there is nothing to keep."""
    parts = F.struct(
        extract.extract_measurement_keys(original).alias("om"),
        extract.extract_measurement_keys(simplified).alias("sm"),
        F.size(F.array_intersect(o_cuis, s_cuis)).alias("cc"), F.size(o_cuis).alias("oc"))
    return let(parts, lambda x: let(F.size(F.array_intersect(x["om"], x["sm"])), lambda kept: F.struct(
        exact_round(ratio(x["cc"], F.nullif(x["oc"], F.lit(0)), 1.0), 4).alias("source_cui_recall"),
        exact_round(ratio(kept, F.nullif(F.size(x["om"]), F.lit(0)), 1.0), 4).alias("key_measurements_present"),
        x["oc"].alias("total_source_cuis"), x["cc"].alias("covered_source_cuis"),
        F.size(x["om"]).alias("total_measurements"), kept.alias("preserved_measurements"))))


def nli_distribution(matches: DataFrame, keys=("pair_id",)) -> DataFrame:
    """Label rates and mean confidences over the matched sentence pairs of each sample."""
    def rate(label: str) -> Column:
        return exact_round(F.avg((F.col("label") == label).cast("int")), 4)

    def conf(label: str) -> Column:
        return exact_round(F.coalesce(F.avg(F.when(F.col("label") == label, F.col("confidence"))), F.lit(0.0)), 4)

    return matches.groupBy(*keys).agg(
        rate("entailment").alias("entailment_rate"), rate("neutral").alias("neutral_rate"),
        rate("contradiction").alias("contradiction_rate"), F.count(F.lit(1)).alias("total_pairs"),
        conf("entailment").alias("avg_entailment_confidence"),
        conf("contradiction").alias("avg_contradiction_confidence"))


def evaluate_samples(df: DataFrame, enabled=EVALUATORS, *, keys=("sample_id",), concepts: bool = False,
                     nli: DataFrame | None = None, semantic: DataFrame | None = None,
                     custom: dict | None = None) -> DataFrame:
    """One struct column per enabled evaluator; a disabled one is null.

    With ``concepts`` the input carries ``orig_concepts`` and ``simp_concepts``
    (see ``terms.match_concepts``).  ``nli`` and ``semantic`` are per-key metric
    tables.  ``custom`` maps a column name to ``f(original, simplified)``.
    ``error`` says which text a row lacks (null: none); such a row counts as an
    empty text, and ``ops_from_stats`` and ``stats_summary`` tell it apart.
    """
    unknown = set(enabled) - set(EVALUATORS) - {"semantic", "nli", "ops"}
    if unknown:
        raise ValueError(f"Unknown evaluators: {sorted(unknown)}")
    o, s = F.coalesce("original", F.lit("")), F.coalesce("simplified", F.lit(""))
    lacking = [F.when(F.col(c).isNull(), F.lit(f"no {c} text")) for c in ("original", "simplified")]
    error = F.nullif(F.concat_ws("; ", *([F.col("error")] if "error" in df.columns else []), *lacking), F.lit(""))
    base = df.withColumns({"error": error, "original": o, "simplified": s})
    o, s = F.col("original"), F.col("simplified")
    oc = F.col("orig_concepts") if concepts else _no_concepts()
    sc = F.col("simp_concepts") if concepts else _no_concepts()
    cols: dict[str, Column] = {}
    if "readability" in enabled:
        cols["readability"] = readability(s, F.size(cuis(sc)) if concepts else None)
    if "simplification" in enabled:
        base = base.withColumns({"_or": simple_readability(o), "_sr": simple_readability(s)})
        cols["readability_comparison"] = compare(F.col("_or"), F.col("_sr"))
        cols["simplification_quality"] = simplification_quality(
            o, s, F.col("_or"), F.col("_sr"), cuis(oc), cuis(sc))
    if "concept" in enabled:
        cols["concept"] = concept_overlap(oc, sc)
    if "coverage" in enabled:
        cols["coverage"] = coverage(o, s, cuis(oc), cuis(sc))
    cols.update({n: f(o, s) for n, f in (custom or {}).items()})
    out = base.withColumns(cols).drop("_or", "_sr") if cols else base
    for name, table in (("nli", nli), ("semantic", semantic)):
        if name in enabled and table is not None:
            packed = table.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias(name))
            out = out.join(packed, list(keys), "left")
    return out


# --------------------------------------------------------------- dataset level
MISSING = ("missing_diagnoses", "missing_medications", "missing_measurements")


def _missing_top(samples: DataFrame, group, k: int) -> DataFrame:
    """First k distinct missing items per group and kind, alphabetically, out of all lists.

    Distinct combines map-side; the rank limit is pushed below the shuffle
    (window group limit), so a hot group sends k rows per task, not its items.
    """
    def kind(name: str) -> Column:
        return F.transform(F.col(f"simplification_quality.{name}"),
                           lambda x: F.struct(F.lit(name).alias("kind"), x.alias("item")))

    tagged = F.flatten(F.array(*[kind(f) for f in MISSING]))
    items = samples.select(*group, F.inline(tagged)).distinct()
    ranked = items.withColumn("rn", F.row_number().over(
        Window.partitionBy(*group, "kind").orderBy("item"))).filter(F.col("rn") <= k)
    return ranked.groupBy(*group).agg(*[F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == f, F.struct("rn", "item")))), lambda x: x["item"]).alias(f)
        for f in MISSING])


def aggregate_dataset(samples: DataFrame, group=("dataset", "model_version"), *, missing: bool = False,
                      missing_items: int = 10, runs: DataFrame | None = None) -> DataFrame:
    """Dataset-level means, sums and pair-weighted rates in one aggregate.

    ``missing`` adds the first ``missing_items`` distinct missing items of each
    kind; ``runs`` (run rows with the group columns) adds ``ops_metrics`` as ``ops_*``.
    """
    def mean(c: str, digits: int) -> Column:
        return exact_round(F.avg(c), digits)

    have = set(samples.columns)
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    if "readability" in have:
        aggs += [mean(f"readability.{f}", d).alias(f"readability_{f}") for f, d in (
            ("fkgl", 2), ("smog", 2), ("avg_sentence_length", 2), ("jargon_density", 4))]
        aggs += [F.sum(f"readability.{f}").alias(f"readability_{f}") for f in ("total_tokens", "cui_count")]
    if "readability_comparison" in have:
        for f in samples.schema["readability_comparison"].dataType.names:
            aggs.append(mean(f"readability_comparison.{f}", 4 if "jargon" in f else 1).alias(f"comparison_{f}"))
    if "simplification_quality" in have:
        aggs += [mean(f"simplification_quality.{f}", d).alias(f"quality_{f}") for f, d in (
            ("concept_recall", 4), ("critical_concept_recall", 4), ("measurement_preservation", 4),
            ("original_words_per_concept", 2), ("simplified_words_per_concept", 2), ("expansion_ratio", 2),
            ("simplification_score", 4))]
    if "semantic" in have:
        aggs += [mean(f"semantic.{f}", 4).alias(f"semantic_{f}") for f in ("precision", "recall", "f1")]
    if "concept" in have:
        aggs += [mean(f"concept.{f}", 4).alias(f"concept_{f}") for f in ("cui_precision", "cui_recall", "cui_f1")]
        aggs += [F.sum(f"concept.{f}").alias(f"concept_{f}") for f in (
            "original_cui_count", "simplified_cui_count", "shared_cui_count")]
        w = "concept.semantic_type_weighted_f1"
        aggs.append(exact_round(F.sum(w) / F.count("concept"), 4).alias("concept_weighted_f1"))
    if "nli" in have:
        pairs = F.sum("nli.total_pairs")
        aggs += [exact_round(F.try_divide(F.sum(F.col(f"nli.{f}") * F.col("nli.total_pairs")), pairs), 4).alias(f"nli_{f}")
                 for f in ("entailment_rate", "neutral_rate", "contradiction_rate")]
        aggs += [pairs.alias("nli_total_pairs")]
        aggs += [mean(f"nli.{f}", 4).alias(f"nli_{f}") for f in (
            "avg_entailment_confidence", "avg_contradiction_confidence")]
    if "coverage" in have:
        aggs += [mean(f"coverage.{f}", 4).alias(f"coverage_{f}") for f in (
            "source_cui_recall", "key_measurements_present")]
        aggs += [F.sum(f"coverage.{f}").alias(f"coverage_{f}") for f in (
            "total_source_cuis", "covered_source_cuis", "total_measurements", "preserved_measurements")]
        aggs.append(exact_round(F.coalesce(F.try_divide(
            F.sum("coverage.preserved_measurements"), F.sum("coverage.total_measurements")), F.lit(1.0)), 4)
            .alias("coverage_micro_measurement_rate"))
    out = samples.groupBy(*group).agg(*aggs)
    if missing and "simplification_quality" in have:
        out = out.join(_missing_top(samples, group, missing_items), list(group), "left")
    if runs is not None:
        ops = ops_metrics(runs, group)
        out = out.join(ops.withColumnsRenamed({c: f"ops_{c}" for c in ops.columns if c not in group}), list(group), "left")
    return out


def baseline_eval(df: DataFrame, enabled=EVALUATORS, **kw) -> DataFrame:
    """Evaluate the reference text as if it were the model output."""
    return evaluate_samples(df.withColumn("simplified", F.col("reference")), enabled, **kw)


# ------------------------------------------------------------------------ ops
RUN_FIELDS = ("latency_ms", "input_tokens", "output_tokens", "retry_count", "refinement_count",
              "first_pass_success")


def record_runs(df: DataFrame, latency_ms="latency_ms", *, group=(), **cols) -> DataFrame:
    """Project any table onto run rows; fields not given take their defaults."""
    defaults = {"input_tokens": F.lit(0), "output_tokens": F.lit(0), "retry_count": F.lit(0),
                "refinement_count": F.lit(0), "first_pass_success": F.lit(True)}
    fields = {**defaults, **{k: (v if isinstance(v, Column) else F.col(v)) for k, v in cols.items()}}
    lat = latency_ms if isinstance(latency_ms, Column) else F.col(latency_ms)
    return df.select(*group, lat.cast("double").alias("latency_ms"),
                     *[v.alias(k) for k, v in fields.items()])


PERCENTILES = {"p50": 0.5, "p95": 0.95}


def _exact_ranks(base: DataFrame, totals: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, p50, p95): the values at 0-based rank floor(n p), exactly.

    ``totals`` has bounds of each percentile from a mergeable sketch. One pass counts
    what lies below them and, value by value, what lies between; only the latter,
    a share of the rows that the sketch's accuracy sets, is put in order. Groups of
    ``rows`` runs or fewer need no bounds.
    """
    few = F.col("runs") <= rows
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"),
                                      F.when(few, F.col("_lo")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                                      F.when(few, F.col("_hi")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"))
                             for i, (n, p) in enumerate(PERCENTILES.items())]))
    state = cut(totals.filter("runs > 0").select(*keys, "runs", at.alias("t")).select(
        *keys, "t.name", F.least(F.floor(F.col("runs") * F.col("t.p")), F.col("runs") - 1).alias("rank"), "t.lo", "t.hi"))
    v = F.col("latency_ms")
    below = F.when(v < F.col("lo"), F.lit(float("-inf"))).otherwise(v)
    hist = base.join(state, keys).filter(v <= F.col("hi")).groupBy(*keys, "name", "rank", below.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("v"))
    found = hist.withColumn("_end", ahead).filter((F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("n")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in PERCENTILES])


def ops_metrics(runs: DataFrame, group=(), accuracy: int = 10_000, rows: int = 10_000) -> DataFrame:
    """Exact 0-based rank percentiles (p50, p95), means and rates per group, in two scans.

    A quantile sketch, whose ranks are off by one in ``accuracy`` at most, bounds
    each percentile (``_exact_ranks``), so no group is put in order by one task.
    Without a group there is one row in any case, of zeros if there are no runs;
    runs without a latency, or with one that is not a finite number, count in rates only.
    """
    keys, margin = list(group), 5 / accuracy  # the sketch's own error, twice, and ranks rounded on either side
    rows = max(rows, accuracy)
    v = F.col("latency_ms").cast("double")
    runs = runs.withColumn("latency_ms", F.when((v > float("-inf")) & (v < float("inf")), v))
    bounds = [min(max(p + m, 0.0), 1.0) for p in PERCENTILES.values() for m in (-margin, margin)]
    aggs = [F.percentile_approx("latency_ms", bounds, accuracy).alias("_q"), F.count("latency_ms").alias("runs"), F.count(F.lit(1)).alias("_rows"), F.avg("latency_ms").alias("_mean"),
            F.min("latency_ms").alias("_lo"), F.max("latency_ms").alias("_hi"),
            F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("_cost"),
            F.avg((F.col("retry_count") > 0).cast("int")).alias("_retry"),
            F.avg((F.col("refinement_count") > 0).cast("int")).alias("_refine"),
            F.avg(F.col("first_pass_success").cast("int")).alias("_first")]
    if not keys:
        keys, runs = ["_all"], runs.withColumn("_all", F.lit(1))
        totals = runs.agg(*aggs).withColumn("_all", F.lit(1))
    else:
        totals = runs.groupBy(*keys).agg(*aggs)
    out = totals.join(_exact_ranks(runs, totals, keys, rows), keys, "left")

    def number(c: str, digits: int) -> Column:
        return exact_round(F.coalesce(F.col(c), F.lit(0.0)), digits)

    return out.select(
        *group, F.col("_rows").alias("runs"), number("p50", 2).alias("latency_p50_ms"), number("p95", 2).alias("latency_p95_ms"),
        number("_mean", 2).alias("latency_mean_ms"), number("_cost", 2).alias("cost_per_report_tokens"),
        number("_retry", 4).alias("retry_rate"), number("_refine", 4).alias("refinement_rate"),
        number("_first", 4).alias("first_pass_success_rate"))


def ops_from_stats(stats: DataFrame, group=()) -> DataFrame:
    """Run rows out of error-free sample statistics."""
    return record_runs(
        stats.filter(F.coalesce("error", F.lit("")) == ""), group=group,
        input_tokens=F.col("original_words"), output_tokens=F.col("simplified_words"),
        retry_count=F.greatest(F.lit(0), F.col("validation_iterations") - 1),
        first_pass_success=F.col("first_pass_success"))


# ---------------------------------------------------------------------- stats
def sample_stats(df: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Length, readability and delta statistics per (original, simplified) row."""
    d = df.withColumns({"_o": simple_readability(F.col("original")), "_s": simple_readability(F.col("simplified"))})
    o, s = F.col("_o"), F.col("_s")
    ow, sw = word_count_ws(F.col("original")), word_count_ws(F.col("simplified"))
    return d.select(
        *keys, F.length("original").alias("original_chars"), ow.alias("original_words"),
        o["fkgl"].alias("original_fkgl"), o["smog"].alias("original_smog"),
        exact_round(o["jargon_density"], 4).alias("original_jargon_density"),
        F.length("simplified").alias("simplified_chars"), sw.alias("simplified_words"),
        s["fkgl"].alias("simplified_fkgl"), s["smog"].alias("simplified_smog"),
        exact_round(s["jargon_density"], 4).alias("simplified_jargon_density"),
        exact_round(s["fkgl"] - o["fkgl"], 1).alias("fkgl_delta"),
        exact_round(s["smog"] - o["smog"], 1).alias("smog_delta"),
        exact_round(o["jargon_density"] - s["jargon_density"], 4).alias("jargon_reduction"),
        exact_round(sw / F.greatest(F.lit(1), ow), 4).alias("expansion_ratio"))


def chunk_iterations(chunks: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Chunk count, mean iterations (floored), review and first-pass flags per sample."""
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.floor(F.sum(F.coalesce("iteration", F.lit(1))) / F.count(F.lit(1))).alias("validation_iterations"),
        F.max("needs_review").alias("needs_review"), (~F.max("needs_review")).alias("first_pass_success"))


def stats_summary(stats: DataFrame) -> DataFrame:
    """Ranges, shares and success counts; score statistics only over positive scores."""
    ok = F.coalesce("error", F.lit("")) == ""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")]
    have = set(stats.columns)

    def spread(c: str, cond: Column) -> list[Column]:
        x = F.when(cond, F.col(c))
        return [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), exact_round(F.avg(x), 4).alias(f"{c}_avg")]

    for c in ("fkgl_delta", "latency_ms"):
        if c in have:
            aggs += spread(c, ok)
    if "simplification_score" in have:
        aggs += spread("simplification_score", ok & (F.col("simplification_score") > 0))
    for c in ("first_pass_success", "needs_review"):
        if c in have:
            aggs.append(exact_round(F.avg(F.when(ok, F.col(c).cast("int"))), 4).alias(f"{c}_share"))
    return stats.agg(*aggs)


def dataset_stats(df: DataFrame, original: str, target: str, dims=("source", "split")) -> DataFrame:
    """Counts and shares per dimension value plus blank and valid totals.

    Everything comes out of one scan: rows are pre-counted per combination of
    dimension values, and only that small table is unfolded.
    """
    def blank(c: str) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) == ""

    cube = df.groupBy(*[F.coalesce(d, F.lit("unknown")).alias(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blank(original)).alias("bo"),
        F.count_if(blank(target)).alias("bt"), F.count_if(blank(original) | blank(target)).alias("be"))
    parts = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]
    parts.append(F.struct(F.lit("total").alias("dim"), F.lit("all").alias("value")))
    tall = cube.select(F.explode(F.array(*parts)).alias("g"), "n", "bo", "bt", "be")
    sums = tall.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "bo", "bt", "be")])
    # the total is one of the few rows of ``sums``
    total = F.max(F.when(F.col("g.dim") == "total", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("_total", total).select(
        "g.dim", "g.value", F.col("n").alias("rows"), exact_round(F.col("n") / F.col("_total"), 4).alias("share"),
        F.col("bo").alias("blank_originals"), F.col("bt").alias("blank_targets"),
        (F.col("n") - F.greatest("bo", "bt")).alias("valid_approx"), (F.col("n") - F.col("be")).alias("valid_exact"))


def log_metrics_long(dataset_eval: DataFrame, groups: dict[str, list[str]], keys=("dataset", "model_version")) -> DataFrame:
    """``prefix/metric -> value`` rows; null metrics are left out."""
    cols = [(f"{p}/{m}", f"{p}_{m}") for p, ms in groups.items() for m in ms]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in cols])
    return dataset_eval.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())

"""Readers.  All are lazy Spark scans; rejects stay in the data with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rx import strip


def read_reports(spark: SparkSession, paths, max_pdf_bytes: int | None = rules.MAX_PDF_BYTES,
                 max_txt_bytes: int | None = rules.MAX_TXT_BYTES) -> DataFrame:
    """Text reports: path, length, text, reject_reason (null when accepted).

    UTF-8 first, Latin-1 otherwise; extension, size and blank gates (None: no
    limit).  The size limit reaches the scan, and pdf, other and oversized files
    are listed without their content.  A pdf passes the gates with null text:
    its page texts come from the caller (``report.assemble_pages``).
    """
    def files(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)

    def small(limit: int | None) -> Column:
        return F.lit(True) if limit is None else F.col("length") <= limit

    raw = F.col("content")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    read = files("*.txt").filter(small(max_txt_bytes)).select("path", "length", text.alias("text")).withColumn(
        "reject_reason", F.when(strip(F.col("text")) == "", "file is empty"))
    pdf, txt = F.col("path").endswith(".pdf"), F.col("path").endswith(".txt")
    too_big = (pdf & ~small(max_pdf_bytes)) | (txt & ~small(max_txt_bytes))
    listed = files("*").filter(~(txt & small(max_txt_bytes))).select(
        "path", "length", F.lit(None).cast("string").alias("text"),
        F.when(~pdf & ~txt, "invalid file type").when(too_big, "file too large").alias("reject_reason"))
    return read.union(listed)


SAMPLE = "struct<sample_id:string,original_text:string,simplified_text:string,reference_text:string>"


def read_samples_json(spark: SparkSession, path: str) -> DataFrame:
    """Sample rows from a top-level list or from ``{"samples": [...]}``; anything else raises."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{SAMPLE}>")
    nested = F.from_json("value", f"samples array<{SAMPLE}>")["samples"]
    is_list = F.col("value").rlike(r"^\ufeff?\s*\[")
    kind = F.coalesce(F.when(is_list, listed).otherwise(nested), F.raise_error(F.lit("Unknown JSON format")).cast(f"array<{SAMPLE}>"))
    return raw.select(F.inline(kind))


def read_samples_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sample rows, one JSON object a line: splits large files, which a single document cannot."""
    fields = ("sample_id", "original_text", "simplified_text", "reference_text")
    return spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path)


PIPELINE_OUTPUT = (
    "simplified_report array<struct<original_chunk:string,simplified_chunk:string,similarity:double,"
    "sources:string,needs_review:boolean,validation:struct<passed:boolean,iteration:int>,"
    "citations:map<string,array<string>>>>")


def read_report_output(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PIPELINE_OUTPUT).json(path, multiLine=True)
    return raw.withColumn("simplified_report", F.coalesce("simplified_report", F.raise_error(
        F.lit("Expected 'simplified_report'")).cast(raw.schema["simplified_report"].dataType)))


def output_samples(reports: DataFrame, keys=()) -> DataFrame:
    """``chunk_{i}`` sample rows out of nested report output."""
    return reports.select(*keys, F.posexplode("simplified_report").alias("i", "c")).select(
        *keys, F.concat(F.lit("chunk_"), F.col("i").cast("string")).alias("sample_id"),
        F.coalesce("c.original_chunk", F.lit("")).alias("original_text"),
        F.coalesce("c.simplified_chunk", F.lit("")).alias("simplified_text"),
        F.lit(None).cast("string").alias("reference_text"))


def read_pair_dataset(spark: SparkSession, path: str, source: str | None = None,
                      split: str | None = None) -> DataFrame:
    """Paired or raw CSV, told apart by its header; see ``clean_pairs``."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    raw = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in raw.columns], F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_place"))
    if "Text" in raw.columns and "original_text" not in raw.columns:
        kept = raw.filter(F.length(strip(F.coalesce("Text", F.lit("")))) >= 50)
        return clean_raw(numbered(kept, "index").select("index", "Text"))
    if "index" not in raw.columns:
        raw = numbered(_whole_pairs(raw, source, split), "index")
    return clean_pairs(raw.drop("_place"), source, split)


def numbered(df: DataFrame, name: str, place: str = "_place") -> DataFrame:
    """Rows numbered from 0 in the order of ``place``; blocks of rows are counted first, so no task sees all rows."""
    d = df.withColumn("_block", F.struct(f"{place}.file_path", f"{place}.file_block_start"))
    sizes = d.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(place)) - 1
    return d.withColumn("_own", own).join(base, "_block").withColumn(name, F.col("_base") + F.col("_own")).drop(
        "_block", "_own", "_base")


def clean_raw(raw: DataFrame) -> DataFrame:
    """Raw reports (index, Text): trimmed, shorter than 50 characters dropped."""
    text = strip(F.coalesce("Text", F.lit("")))
    return raw.select(F.col("index").cast("string").alias("sample_id"), text.alias("original_text"),
                      F.lit(None).cast("string").alias("reference_text"),
                      F.lit("reports").alias("source_dataset"), F.lit("unknown").alias("split")).filter(
        F.length("original_text") >= 50)


def _whole_pairs(raw: DataFrame, source: str | None, split: str | None) -> DataFrame:
    """Rows of the source and split asked for, whose texts are both more than blanks."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")

    kept = raw
    for name, want in (("source_dataset", source), ("split", split)):
        if want:
            kept = kept.filter(F.lower(text(name)) == want.lower())
    return kept.filter((strip(text("original_text")) != "") & (strip(text("plain_language_text")) != ""))


def clean_pairs(raw: DataFrame, source: str | None = None, split: str | None = None) -> DataFrame:
    """Pairs with both texts non-blank; optional case-insensitive source and split filters.

    A missing source or split column reads ``unknown``; an empty value stays empty.
    """
    def col(name: str, default: str | None = None) -> Column:
        if name not in raw.columns:
            return F.lit(default).cast("string")
        return F.coalesce(F.col(name), F.lit("")) if default is not None else F.col(name)

    return _whole_pairs(raw, source, split).select(
        col("index").cast("string").alias("sample_id"), strip(col("original_text", "")).alias("original_text"),
        strip(col("plain_language_text", "")).alias("reference_text"),
        col("source_dataset", "unknown").alias("source_dataset"), col("split", "unknown").alias("split"))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Reproducible sample of n rows by seeded hash order; all rows when n <= 0.

    A top-n (not a sort): every task keeps n rows.
    """
    if n <= 0:
        return df
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def read_rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Pipe-delimited rows: trailing pipes stripped, short rows padded with "".

    ``ord`` follows file order: the file, the block start inside it, then the row id.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    kept = spark.read.text(path).select("value", place.alias("ord")).filter(F.col("value") != "")
    return parse_rrf(kept, columns)


def parse_rrf(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``value`` and ``ord`` columns -> one string column per name plus ``ord``."""
    parts = lines.filter(F.col("value") != "").select(
        F.split(F.regexp_replace("value", r"\|+\z", ""), r"\|", -1).alias("p"), "ord")
    return parts.select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], "ord")


CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip_fences(c: Column) -> Column:
    """Content of the first markdown code block, if there is one."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return F.when(c.contains("```"), strip(inner)).otherwise(c)


def parse_model_json(c: Column, schema: str) -> Column:
    """Model output to ``schema``: strict, control characters removed, raw newlines inside
    strings allowed, then the first bracketed block.  Null when nothing parses."""
    t = strip_fences(c)
    clean = F.regexp_replace(t, CONTROL, "")
    block = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    array = schema if schema.startswith("array<") else f"array<{schema}>"

    def strict(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, array))

    lax = F.from_json(t, array, {"allowUnquotedControlChars": "true"})
    found = F.coalesce(strict(t), strict(clean), lax, strict(block))
    return found if schema.startswith("array<") else found[0]

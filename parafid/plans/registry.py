"""Query registry: each entry pairs a Spark job with its DuckDB check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqlkit import exact_rounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name`` with an optional oracle text."""
    def wrap(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = exact_rounds(oracle)
        return f
    return wrap

"""Every query with a DuckDB text against it, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from check_sql import compare  # noqa: E402
from oracle import connect  # noqa: E402

from parafid.llm import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, name):
    ok, info = compare(spark, connect(sf_dir), name, sf_dir)
    assert ok, info


def test_operators_are_registered():
    import __spark_entry__
    import corpus_pipeline
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination",
                                                      "secret scan", "mixing sources"]

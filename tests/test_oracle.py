"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from oracle import compare, connect

from parafid.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, info = compare(spark, con, name, sf_dir)
    assert ok, info

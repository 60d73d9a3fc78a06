"""Every registered query with SQL equals DuckDB's answer on the smallest tables."""

import os

import pytest

from spanloom.plans import registry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF_DIR) is None

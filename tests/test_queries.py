"""Registered queries against their DuckDB oracles on the smallest test tables."""

import os

import pytest

from compare import connect, differences, oracle_rows, spark_rows
from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(spark_rows(QUERIES[name](spark, SF)), oracle_rows(con, ORACLES[name])) == []

"""Every query against its DuckDB form on the smallest tables."""

import pytest
from oracle import differences

from graphloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_duckdb(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None

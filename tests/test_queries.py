"""Every query of the library against its DuckDB SQL, over whole small tables."""

from __future__ import annotations

import pytest
from oracle import difference, tables

from graphloom.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_with_a_stable_schema(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert frame.columns and frame.count() >= 0
    assert QUERIES[name](spark, SMALL).schema == frame.schema

"""Every registered query against its DuckDB oracle (row count, column
names and values, order-insensitive)."""

import pytest

import __spark_entry__ as entry
from flowtrace.plans.bound import QUERIES as LAZY
from flowtrace.plans.bound import SINKS
from flowtrace.plans.oracle import oracle_sql

from .compare import compare, duckdb_connection
from .conftest import SF_ORACLE, SF_SMALL

QUERIES = {name: query for name, query in entry.queries().items() if name in {**LAZY, **SINKS}}
ORACLES = oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con_small():
    return duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_small(spark, con_small, name):
    result = compare(QUERIES[name](spark, SF_SMALL), con_small, ORACLES[name])
    assert result["match"], result
    assert result["spark_rows"] > 0


@pytest.fixture(scope="module")
def con_oracle():
    return duckdb_connection(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_sf001(spark, con_oracle, name):
    result = compare(QUERIES[name](spark, SF_ORACLE), con_oracle, ORACLES[name])
    assert result["match"], result


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "hop_sequence"


@pytest.mark.parametrize("name", ["hop_log", "bridge_drain", "intervention_hourly",
                                  "log_decode_daily", "laundering_v1"])
def test_results_do_not_depend_on_ansi_mode(spark, con_small, name):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        result = compare(QUERIES[name](spark, SF_SMALL), con_small, ORACLES[name])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert result["match"], result

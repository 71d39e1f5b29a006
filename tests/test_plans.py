"""Physical-plan checks: no nested-loop or cartesian joins, no Python
workers, filters reach the scan, partitions are pruned."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowtrace.plans.bound import QUERIES
from flowtrace.plans import recipes as R
from flowtrace.sources import bindings as B
from flowtrace.sources.tables import read_chain_table, write_chain_table

from .conftest import SF_SMALL

BAD_NODES = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_or_python(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    text = plan_text(df)
    for node in BAD_NODES:
        assert node not in text, f"{name}: {node}"


def test_partition_pruning_and_pushdown(spark, scratch):
    path = f"{scratch}/arbitrum_transactions"
    write_chain_table(B.arbitrum_transactions(spark, SF_SMALL), path, "arbitrum_transactions")
    txs = read_chain_table(spark, "arbitrum_transactions", path)
    scoped = txs.where(F.col("block_date").between(dt.date(1996, 1, 1), dt.date(1996, 1, 31))
                       & (F.col("from") == F.lit((7).to_bytes(20, "big"))))
    text = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_date" in text
    assert "PushedFilters: [IsNotNull(from), EqualTo(from," in text
    out = R.arbitrum_intervention(txs, council=(7).to_bytes(20, "big"),
                                  executor=(3).to_bytes(20, "big"),
                                  council_dates=(dt.date(1996, 1, 1), dt.date(1997, 1, 1)),
                                  route_dates=(dt.date(1996, 1, 1), dt.date(1996, 6, 1)),
                                  council_min=10, route_min=90000, exact=True)
    assert out.count() > 0


def test_raw_threshold_reaches_the_scan(spark, scratch):
    from flowtrace.operators.transfers import raw_floor
    path = f"{scratch}/tron_transactions"
    write_chain_table(B.tron_transactions(spark, SF_SMALL), path, "tron_transactions")
    txs = read_chain_table(spark, "tron_transactions", path)
    for exact in (True, False):
        text = plan_text(txs.where(raw_floor("value", 50000, 6, exact)))
        assert "PushedFilters: [IsNotNull(value), GreaterThan(value," in text


def test_hourly_series_preaggregates_before_shuffle(spark):
    df = entry.queries()["hourly_legs"](spark, SF_SMALL)
    text = plan_text(df)
    assert "partial_sum" in text


def test_partitioned_write_rebalances_by_date(spark, scratch):
    df = B.tron_transactions(spark, SF_SMALL).hint("rebalance", "block_date")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_a_query_runs_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    entry.queries()[name](spark, SF_SMALL)
    assert set(tracker.getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("name", ["hop_log", "bridge_drain"])
def test_ordered_rows_are_exchanged_once(spark, name):
    """Rows go through one exchange by (time, …); the others carry totals."""
    text = plan_text(QUERIES[name](spark, SF_SMALL).select("*"))
    assert "SinglePartition" in text  # one row per day, for the last level
    assert "Checkpoint" not in text and "CartesianProduct" not in text


def test_time_windows_prune_partitions_of_transfers_and_swaps(spark, scratch):
    for name, build in (("erc20_evt_transfer", B.erc20_evt_transfer), ("thorchain_swaps", B.thorchain_swaps)):
        path = f"{scratch}/pruned_{name}"
        write_chain_table(build(spark, SF_SMALL), path, name)
        src = read_chain_table(spark, name, path)
        window = (dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1))
        out = R.bridge_drain(src, window=window) if name.startswith("erc20") else \
            R.thorchain_daily(src, window=window)
        assert "PartitionFilters: [isnotnull(block_date" in plan_text(out)

"""Rows that are dropped before they cost anything: row groups by order and
Parquet Bloom filters, transfers off the watchlists by a Bloom filter."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowtrace.operators import watchlist_roles, watchlist_transfers
from flowtrace.operators.membership import bloom_filter, might_contain, touching
from flowtrace.plans import constants as K
from flowtrace.plans import recipes as R
from flowtrace.sources import bindings as B
from flowtrace.sources.tables import read_chain_table, write_chain_table

from .conftest import SF_SMALL


def scanned(df):
    """Rows that the scan of ``df`` (no exchange) hands on, after a run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def address(n):
    return int(n).to_bytes(20, "big")


@pytest.fixture(scope="module")
def transfers_rows(spark):
    """Two dates, one token in most rows, addresses spread evenly."""
    hashed = F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(50000))), 40, "0"))
    return spark.range(60000).select(
        (F.lit(dt.datetime(2026, 4, 18)) + F.expr("make_dt_interval(cast(id % 2 as int))")).alias("block_time"),
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("tx_hash"),
        hashed.alias("from"), F.unhex(F.lpad(F.hex(F.col("id")), 40, "0")).alias("to"),
        (F.col("id") * 1000).cast("decimal(38,0)").alias("value"),
        F.unhex(F.lpad(F.hex(F.col("id") % 50), 40, "0")).alias("contract_address"),
        F.date_add(F.lit(dt.date(2026, 4, 18)), (F.col("id") % 2).cast("int")).alias("block_date"))


@pytest.fixture(scope="module")
def stored_pair(spark, scratch, transfers_rows):
    """The table clustered with Bloom filters, and without either."""
    paths = [f"{scratch}/erc20_clustered", f"{scratch}/erc20_plain"]
    write_chain_table(transfers_rows, paths[0], "erc20_evt_transfer", row_group_bytes=128 * 1024)
    write_chain_table(transfers_rows, paths[1], "erc20_evt_transfer", row_group_bytes=128 * 1024,
                      cluster_by=(), bloom=())
    return [read_chain_table(spark, "erc20_evt_transfer", p) for p in paths]


def test_clustered_files_hold_the_same_rows(stored_pair, transfers_rows):
    for df in stored_pair:
        assert df.exceptAll(transfers_rows.select(*df.columns)).count() == 0
        assert df.count() == 60000


@pytest.mark.parametrize("column, value", [
    ("contract_address", address(7)),                       # by the order of rows
    ("tx_hash", hashlib.sha256(b"4321").digest())])         # by a Bloom filter only
def test_row_groups_are_skipped(stored_pair, column, value):
    clustered, plain = (df.where(F.col(column) == F.lit(value)) for df in stored_pair)
    assert clustered.count() > 0
    assert scanned(clustered) <= 0.4 * scanned(plain)
    assert clustered.exceptAll(plain).count() == plain.exceptAll(clustered).count() == 0


def test_hot_date_and_missing_columns_are_written(spark, scratch):
    rows = [(dt.date(2026, 4, 18) if i % 3 else None, None if i % 5 == 0 else address(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "block_date date, contract_address binary")
    write_chain_table(df, f"{scratch}/erc20_partial", "erc20_evt_transfer")
    back = spark.read.schema(df.schema).parquet(f"{scratch}/erc20_partial").select(*df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == 300
    write_chain_table(df.limit(0), f"{scratch}/erc20_none", "erc20_evt_transfer")
    assert spark.read.schema(df.schema).parquet(f"{scratch}/erc20_none").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    rng = random.Random(5)
    listed = [address(rng.randrange(10 ** 12)) for _ in range(3000)]
    watch = spark.createDataFrame([(a,) for a in listed] + [(None,)], "a binary")
    others = [address(10 ** 12 + i) for i in range(3000)]
    df = spark.createDataFrame([(a, True) for a in listed] + [(a, False) for a in others],
                               "address binary, listed boolean")
    passed = df.where(might_contain(bloom_filter(watch), F.col("address"))).groupBy("listed").count()
    got = {r["listed"]: r["count"] for r in passed.collect()}
    assert got[True] == 3000 and got.get(False, 0) < 60
    # A filter far too small for its list passes more, never less.
    tight = df.where(might_contain(bloom_filter(watch, 64), F.col("address"), 64))
    assert tight.where("listed").count() == 3000
    assert df.where(might_contain(bloom_filter(watch.limit(0)), F.col("address"))).count() == 0


def test_touching_leaves_other_types_alone(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "sender int, receiver int")
    watch = spark.createDataFrame([(4,)], "a long")
    assert touching(df, ("sender", "receiver"), [watch]).count() == 2
    got = watchlist_transfers(df, watch)
    assert [(r.sender, r.receiver) for r in got.collect()] == [(3, 4)]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_hot_addresses_on_and_off_the_list(spark, broadcast):
    """One listed and one other address hold a third of all rows each."""
    rng = random.Random(8)
    hot, busy = address(1), address(2)
    rows = [(hot if i % 3 == 0 else busy if i % 3 == 1 else address(rng.randrange(3, 500)),
             None if i % 7 == 0 else address(rng.randrange(3, 500)), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "sender binary, receiver binary, i int")
    origin, suspect = [hot, address(77)], [address(5), address(6)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        tables = [spark.createDataFrame([(a,) for a in w], "a binary") for w in (origin, suspect)]
        got = watchlist_roles(df, *tables, K.ROLE_LABELS)
        want = watchlist_roles(df, origin, suspect, K.ROLE_LABELS).select(*got.columns)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert got.where(F.col("sender") == F.lit(hot)).count() == 2000
        mixed = watchlist_roles(df, tables[0], suspect, K.ROLE_LABELS).select(*got.columns)
        assert mixed.exceptAll(want).count() == want.exceptAll(mixed).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bloom_filter_runs_before_any_exchange(spark, stored_pair):
    """In the bridge drain over a stored table the scan's own filter tests the
    Bloom filter, so what is off the lists never reaches a join."""
    watch = [spark.createDataFrame([(address(a),)], "a binary") for a in (11, 12)]
    out = R.bridge_drain(stored_pair[0], contract=address(7), origin=watch[0], suspect=watch[1],
                         window=(dt.datetime(2026, 4, 18), dt.datetime(2026, 4, 20)), exact=True)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()

    def depth(line):
        return next(i for i, c in enumerate(line) if c.isalpha())

    scans = [i for i, line in enumerate(lines) if "Relation" in line and "contract_address" in line]
    assert scans
    for i in scans:
        above = next(j for j in range(i - 1, -1, -1) if depth(lines[j]) < depth(lines[i]))
        assert lines[above][depth(lines[above]):].startswith("Filter") and "scalar-subquery" in lines[above]


def test_registered_bridge_drain_reads_the_filter(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["bridge_drain"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
    assert B.erc20_evt_transfer(spark, SF_SMALL).count() > 0

"""Chain-table stand-ins derived from the driver's TPC-H-style tables.

The test data has no blockchain tables, so each chain table the recipes
read is *derived by Spark* from a driver table with the same row-level
shape: every source row becomes one chain row, so the work grows with the
data. Money columns are decimals (the driver data has cents), which makes
exact, engine-independent results possible. ``ORACLE_VIEWS`` in
:mod:`flowtrace.plans.oracle` builds the same views in DuckDB SQL.

Mapping (B1…B6 in SURVEY §7.3):

* ``rseth_evt_transfer`` from ``events``: block = hour of ``ts``, hash =
  ``user_id`` (one transaction per user and block, with many transfers), log
  index = ``event_id``, sender = address of ``user_id``, receiver = address of
  ``event_type``, raw 18-decimal value = ``value`` · 10^18 + ``event_id``, so
  that the last decimals matter.
* ``erc20_evt_transfer`` / ``arbitrum_transactions`` from ``lineitem`` ⋈
  ``orders``: hash = ``l_suppkey`` (transfers) or ``l_orderkey``
  (transactions), time = ``l_shipdate`` (transactions: plus ``l_orderkey`` mod
  24 hours), sender = address of ``l_suppkey``, receiver = address of ``o_custkey``, raw value =
  ``l_extendedprice`` · 10^18, token contract = address of
  ``l_linestatus``, success = ``l_returnflag <> 'R'``.
* ``lending_supply`` / ``lending_borrow`` from ``events``: purchase =
  deposit, error = withdraw (rsETH, supply); signup = borrow (WETH), click =
  repay (ETH), view = borrow of USDC (borrow).
* ``thorchain_swaps`` from ``lineitem`` ⋈ ``part``: assets = ``p_type`` ->
  ``p_brand``, USD = price · discount, amounts = quantity · discount · tax and
  price · tax · discount.
* ``tron_logs`` / ``tron_transactions`` from ``lineitem``: 6-decimal amount =
  price, contract = ``0x41`` + address of ``l_linestatus``, topic = Transfer
  unless the line was returned.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import int_to_bytes, text_to_bytes, truncate_time
from ..plans import constants as K

ADDRESS_BYTES = 20
HASH_BYTES = 32
# Topic of a log that is not a transfer (the ERC-20 Approval event).
APPROVAL_TOPIC = bytes.fromhex(
    "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925")


#: The driver tables' columns, given so that no job has to read the footers.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str):
    """A 2-decimal double column as an exact decimal(18,2)."""
    return F.col(col).cast("decimal(18,2)")


def raw18(col: str):
    """A 2-decimal amount as a raw 18-decimal integer (uint256-like)."""
    return (cents(col) * F.lit(10 ** 18)).cast("decimal(38,0)")


def address(col: str):
    return int_to_bytes(F.col(col), ADDRESS_BYTES)


def token_address(col: str):
    return text_to_bytes(F.col(col), ADDRESS_BYTES)


def rseth_evt_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    hour = truncate_time("ts", "hour", like=ev.schema["ts"].dataType)
    return ev.select(
        int_to_bytes(F.col("user_id"), HASH_BYTES).alias("evt_tx_hash"),
        F.col("event_id").alias("evt_index"),
        hour.alias("evt_block_time"),
        F.floor(F.unix_micros(hour.cast("timestamp")) / F.lit(3_600_000_000)).alias("evt_block_number"),
        address("user_id").alias("from"),
        token_address("event_type").alias("to"),
        (raw18("value") + F.col("event_id")).cast("decimal(38,0)").alias("value"),
        F.to_date("ts").alias("evt_block_date"))


def _lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag",
        "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")


def erc20_evt_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = _lines_with_orders(spark, sf_dir)
    return lo.select(
        F.col("l_shipdate").alias("block_time"),
        int_to_bytes(F.col("l_suppkey"), HASH_BYTES).alias("tx_hash"),
        address("l_suppkey").alias("from"),
        address("o_custkey").alias("to"),
        raw18("l_extendedprice").alias("value"),
        token_address("l_linestatus").alias("contract_address"),
        F.to_date("l_shipdate").alias("block_date"))


def arbitrum_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = _lines_with_orders(spark, sf_dir)
    return lo.select(
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_orderkey") % 24)).alias("block_time"),
        F.col("l_orderkey").alias("block_number"),
        int_to_bytes(F.col("l_orderkey"), HASH_BYTES).alias("hash"),
        address("l_suppkey").alias("from"),
        address("o_custkey").alias("to"),
        raw18("l_extendedprice").alias("value"),
        F.to_date("l_shipdate").alias("block_date"),
        (F.col("l_returnflag") != F.lit("R")).alias("success"))


# event_type -> (table, transaction_type, symbol)
LENDING_MAP = {
    "purchase": ("supply", "deposit", "rsETH"),
    "error": ("supply", "withdraw", "rsETH"),
    "signup": ("borrow", "borrow", "WETH"),
    "click": ("borrow", "repay", "ETH"),
    "view": ("borrow", "borrow", "USDC"),
}
LENDING_USD_PRICE = "2506.5"


def _lending(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    types = {k: v for k, v in LENDING_MAP.items() if v[0] == table}
    tx_type = F.lit(None).cast("string")
    symbol = F.lit(None).cast("string")
    for event, (_, t, s) in types.items():
        tx_type = F.when(F.col("event_type") == F.lit(event), F.lit(t)).otherwise(tx_type)
        symbol = F.when(F.col("event_type") == F.lit(event), F.lit(s)).otherwise(symbol)
    return ev.where(F.col("event_type").isin(list(types))).select(
        F.col("ts").alias("block_time"),
        F.trunc(F.to_date("ts"), "month").alias("block_month"),
        F.lit("ethereum").alias("blockchain"),
        F.lit("aave").alias("project"),
        symbol.alias("symbol"),
        tx_type.alias("transaction_type"),
        cents("value").alias("amount"),
        (cents("value") * F.lit(Decimal(LENDING_USD_PRICE))).alias("amount_usd"))


def lending_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lending(spark, sf_dir, "supply")


def lending_borrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lending(spark, sf_dir, "borrow")


def thorchain_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lp = li.join(part, li.l_partkey == part.p_partkey, "inner")
    price = cents("l_extendedprice")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    qty = F.col("l_quantity").cast("decimal(8,2)")
    return lp.select(
        F.col("l_shipdate").alias("block_timestamp"),
        F.col("l_orderkey").cast("string").alias("tx_id"),
        F.col("l_suppkey").cast("string").alias("from_address"),
        F.col("p_type").alias("from_asset"),
        F.col("p_brand").alias("to_asset"),
        (qty * disc * tax).alias("from_amount"),
        (price * tax * disc).alias("to_amount"),
        (price * disc).alias("from_amount_usd"),
        F.to_date("l_shipdate").alias("block_date"))


def tron_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus",
        "l_returnflag", "l_shipdate")
    micro = (cents("l_extendedprice") * F.lit(10 ** 6)).cast("bigint")
    return li.select(
        F.col("l_shipdate").alias("block_time"),
        F.to_date("l_shipdate").alias("block_date"),
        int_to_bytes(F.col("l_orderkey"), HASH_BYTES).alias("tx_hash"),
        address("l_suppkey").alias("tx_from"),
        address("l_partkey").alias("tx_to"),
        int_to_bytes(micro, HASH_BYTES).alias("data"),
        F.concat(F.lit(b"\x41"), token_address("l_linestatus")).alias("contract_address"),
        F.when(F.col("l_returnflag") != F.lit("R"), F.lit(K.ERC20_TRANSFER_TOPIC))
         .otherwise(F.lit(APPROVAL_TOPIC)).alias("topic0"))


def wide_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log payloads that fill all 256 bits: four keys of a line as 64-bit
    limbs, three of them counted down from 2^64 - 1."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")

    def limb(c):
        return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))

    return li.select(
        F.col("l_shipdate").alias("block_time"), F.to_date("l_shipdate").alias("block_date"),
        F.concat(*(limb(F.lit(-1) - F.col(c)) for c in ("l_partkey", "l_linenumber")), limb(F.col("l_suppkey")),
                 limb(F.lit(-1) - F.col("l_orderkey"))).alias("data"))


def tron_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", "l_returnflag", "l_shipdate")
    return li.select(
        F.to_date("l_shipdate").alias("block_date"),
        (cents("l_extendedprice") * F.lit(10 ** 6)).cast("decimal(38,0)").alias("value"),
        (F.col("l_returnflag") != F.lit("R")).alias("success"))


def nation_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: money flowing from supplier nations to customer nations, one
    weighted edge per (supplier nation, customer nation), in USD millions."""
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cust = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn, cn = nation.alias("sn"), nation.alias("cn")
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Customers join the orders (a quarter of the lines) first, then the lines
    # once. Lines are summed per pair of nation keys, and only these few sums
    # get names (a name can stand for several keys, so it sums again).
    buyers = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_nationkey")
    keyed = (li.join(buyers, li.l_orderkey == buyers.o_orderkey)
               .join(supp, F.col("l_suppkey") == supp.s_suppkey)
               .groupBy("s_nationkey", "c_nationkey").agg(F.sum(cents("l_extendedprice")).alias("cents")))
    return (keyed.join(sn, F.col("s_nationkey") == F.col("sn.n_nationkey"))
                 .join(cn, F.col("c_nationkey") == F.col("cn.n_nationkey"))
                 .groupBy(F.col("sn.n_name").alias("source_node"), F.col("cn.n_name").alias("target_node"))
                 .agg((F.sum("cents").cast("decimal(28,2)") * F.lit(Decimal("0.000001"))).alias("value_usd_m")))


CHAIN_TABLES = {
    "rseth_evt_transfer": rseth_evt_transfer,
    "erc20_evt_transfer": erc20_evt_transfer,
    "arbitrum_transactions": arbitrum_transactions,
    "lending_supply": lending_supply,
    "lending_borrow": lending_borrow,
    "thorchain_swaps": thorchain_swaps,
    "tron_logs": tron_logs,
    "wide_logs": wide_logs,
    "tron_transactions": tron_transactions,
}

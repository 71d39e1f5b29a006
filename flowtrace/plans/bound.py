"""Registered queries: every dashboard and operator run on the driver data.

Each entry takes ``(spark, sf_dir)``, derives the chain tables it needs from
the driver tables (:mod:`flowtrace.sources.bindings`) and runs a recipe or
operator over the *whole* derived table. Parameters that the dashboards
hard-code for April 2026 are re-aimed at the driver data's time span and
magnitudes (listed in ``PARAMS``); the filters themselves are the
dashboards' features, not sampling.

All money arithmetic runs in exact decimals and is returned as double, so
the DuckDB oracle in :mod:`flowtrace.plans.oracle` can match it exactly.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.scalars import hex_0x, hex_upper, round_scaled, shorten
from ..operators import findings, graph, series, transfers
from ..operators.ordered import sorted_result, with_position
from ..session import ensure_checkpoint_dir
from ..sources import bindings as B
from ..sources.tables import write_result
from . import constants as K
from . import recipes as R

D = dt.date
TS = dt.datetime

PARAMS = {
    "hop_log": dict(dates=(D(2024, 1, 3), D(2024, 1, 27)), min_amount=10,
                    bounds=(200, 100, 50), price=2506.0,
                    labels=("over 200", "100 to 200", "50 to 100", "under 50")),
    "bridge_drain": dict(window=(TS(1996, 1, 1), TS(2000, 1, 1)), price=2506.5,
                         origin_nation=7, suspect_nation=3, token="F"),
    "contagion": dict(window=(TS(2024, 1, 5), TS(2024, 1, 25))),
    "tvl": dict(window=(TS(2024, 1, 2), TS(2024, 1, 29)), pivot=D(2024, 1, 18)),
    "intervention": dict(council_key=7, executor_key=3,
                         council_dates=(D(1995, 6, 1), D(2000, 12, 31)),
                         route_dates=(D(1996, 1, 1), D(1999, 12, 31)),
                         council_min=10, route_min=90000, price=2506.0),
    "swaps": dict(window=(TS(1996, 1, 1), TS(2000, 1, 1)), from_pattern="%A%",
                  to_pattern="%#1%", min_usd=2000),
    "tron": dict(dates=(D(1996, 1, 1), D(2000, 1, 1)), token="F", min_transfer=50000,
                 min_units=50000, price=0.12),
    "recovered_nodes": ("NATION_13", "NATION_21"),
}


def _doubles(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------- Q1 ------

def hop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: transfers above the threshold in a closed date window, numbered, tiered, with a running total."""
    p = PARAMS["hop_log"]
    return R.inception_hop_log(B.rseth_evt_transfer(spark, sf_dir), dates=p["dates"],
                               min_amount=p["min_amount"], bounds=p["bounds"],
                               labels=p["labels"], price=p["price"], exact=True)


def primary_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-5: the largest hop of the hop log."""
    p = PARAMS["hop_log"]
    return R.primary_drain(B.rseth_evt_transfer(spark, sf_dir), dates=p["dates"], min_amount=p["min_amount"],
                           bounds=p["bounds"], labels=p["labels"], price=p["price"], exact=True)


def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-6: hop count, first and last hop time, and the span in seconds.
    Counts and times need no hop numbers, so the log is filtered only."""
    p = PARAMS["hop_log"]
    src = transfers.in_window(B.rseth_evt_transfer(spark, sf_dir), "evt_block_date", *p["dates"],
                              closed=True)
    hops = src.where(transfers.raw_floor("value", p["min_amount"], 18, exact=True))
    return findings.dispersion(hops, "evt_block_time")


def severity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-2 on every transfer of the hop-log window (no threshold): rows,
    volume and amount range per severity tier."""
    p = PARAMS["hop_log"]
    src = B.rseth_evt_transfer(spark, sf_dir)
    canon = transfers.normalize_transfers(
        transfers.in_window(src, "evt_block_date", *p["dates"], closed=True),
        tx_hash="evt_tx_hash", block_time="evt_block_time", sender="from", receiver="to",
        value="value", decimals=0, exact=True)
    tiered = transfers.severity_tier(
        canon, "amount", [Decimal(b).scaleb(18) for b in p["bounds"]], p["labels"])
    return tiered.groupBy("transfer_type").agg(
        F.count(F.lit(1)).alias("transfers"),
        *(round_scaled(f("amount"), 18, digits, exact=True).cast("double").alias(name)
          for f, digits, name in ((F.sum, 2, "volume"), (F.min, 6, "min_amount"),
                                  (F.max, 6, "max_amount"))))


def address_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-13…16, 18 on every ERC-20 transfer: hashes and addresses as
    upper-case hex, ``0x`` lower-case hex and shortened forms."""
    t = B.erc20_evt_transfer(spark, sf_dir)
    # Each value is written in hex once; the display forms are cut from that.
    t = t.select(
        "block_time", hex_upper("tx_hash").alias("tx_hash_hex"), hex_0x("tx_hash").alias("tx_hash_full"),
        hex_0x("from").alias("from_full"), hex_0x("to").alias("to_full"),
        hex_upper("contract_address").alias("contract_hex"),
        (F.col("from") == F.lit((7).to_bytes(B.ADDRESS_BYTES, "big"))).alias("from_watched"))
    return t.select(
        "block_time", "tx_hash_hex", "tx_hash_full", shorten("tx_hash_full", 18).alias("tx_hash_short"),
        "from_full", shorten("from_full", 10).alias("from_addr"), shorten("to_full", 10).alias("to_addr"),
        "contract_hex", "from_watched")


# ---------------------------------------------------------------- Q1b -----

def _nation_watchlists(spark: SparkSession, sf_dir: str):
    p = PARAMS["bridge_drain"]
    supplier = B._table(spark, sf_dir, "supplier")
    customer = B._table(spark, sf_dir, "customer")
    origin = supplier.where(F.col("s_nationkey") == p["origin_nation"]) \
        .select(B.address("s_suppkey").alias("address"))
    suspect = customer.where(F.col("c_nationkey") == p["suspect_nation"]) \
        .select(B.address("c_custkey").alias("address"))
    return origin, suspect


def bridge_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1b: watchlist transfers of one token with roles and the exploit running total."""
    p = PARAMS["bridge_drain"]
    origin, suspect = _nation_watchlists(spark, sf_dir)
    contract = p["token"].encode().rjust(B.ADDRESS_BYTES, b"\x00")
    return R.bridge_drain(B.erc20_evt_transfer(spark, sf_dir), contract=contract,
                          origin=origin, suspect=suspect, window=p["window"],
                          price=p["price"], exact=True)


# ---------------------------------------------------------------- Q2 / Q2b -

def hourly_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: hourly collateral supplied vs ETH/WETH borrowed, aligned, with cumulative borrow."""
    p = PARAMS["contagion"]
    return R.aave_contagion(B.lending_supply(spark, sf_dir), B.lending_borrow(spark, sf_dir),
                            window=p["window"], exact=True)


def daily_net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2b: daily net supply and borrow flows, cumulative net supply, period flag."""
    p = PARAMS["tvl"]
    return R.aave_tvl_drop(B.lending_supply(spark, sf_dir), B.lending_borrow(spark, sf_dir),
                           window=p["window"], pivot=p["pivot"], exact=True)


def _supply_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = PARAMS["contagion"]
    leg = R.lending_leg(B.lending_supply(spark, sf_dir), window=p["window"],
                        chain="ethereum", project="aave", symbols=("rsETH",))
    return series.bucket_flow(leg, "block_time", "hour",
                              {"rseth_supplied": F.sum("amount")}, bucket="hour_bucket")


def peak_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-3: the hour with the most collateral supplied."""
    peak = findings.peak_bucket(_supply_hourly(spark, sf_dir), "hour_bucket", "rseth_supplied")
    return _doubles(peak, {"peak_rseth_supplied"})


def leverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-4: borrowed over deposited collateral (USD) in the contagion window."""
    p = PARAMS["contagion"]
    collateral = R.lending_leg(B.lending_supply(spark, sf_dir), window=p["window"],
                               chain="ethereum", project="aave", symbols=("rsETH",),
                               types=("deposit",))
    borrowed = R.lending_leg(B.lending_borrow(spark, sf_dir), window=p["window"],
                             chain="ethereum", project="aave", symbols=("ETH", "WETH"),
                             types=("borrow",))
    out = findings.leverage_ratio(collateral, borrowed, "amount_usd", "amount_usd")
    return _doubles(out, {"total_collateral", "total_borrowed"})


# ---------------------------------------------------------------- Q3 ------

def intervention_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: watched-address activity plus large moves (NOT IN), per hour and flow type."""
    p = PARAMS["intervention"]
    council = p["council_key"].to_bytes(B.ADDRESS_BYTES, "big")
    executor = p["executor_key"].to_bytes(B.ADDRESS_BYTES, "big")
    return R.arbitrum_intervention(
        B.arbitrum_transactions(spark, sf_dir), council=council, executor=executor,
        council_dates=p["council_dates"], route_dates=p["route_dates"],
        council_min=p["council_min"], route_min=p["route_min"], price=p["price"],
        exact=True)


# ---------------------------------------------------------------- Q4 / Q4v2 -

SWAP_COLS = {"total_swap_usd_m", "total_sent", "total_received"}


def _swaps(spark, sf_dir, round_rows):
    p = PARAMS["swaps"]
    return R.thorchain_daily(B.thorchain_swaps(spark, sf_dir), window=p["window"],
                             from_pattern=p["from_pattern"], to_pattern=p["to_pattern"],
                             min_usd=p["min_usd"], round_rows=round_rows, exact=True)


def swap_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4v2 leg A: large swaps per day, summed then rounded."""
    return _doubles(_swaps(spark, sf_dir, False), SWAP_COLS)


def swap_daily_rounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 leg A: large swaps per day, each swap rounded first."""
    return _doubles(_swaps(spark, sf_dir, True), SWAP_COLS)


def swap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 leg A, row by row: large swaps with their route label."""
    p = PARAMS["swaps"]
    return R.swap_log(B.thorchain_swaps(spark, sf_dir), window=p["window"],
                      from_pattern=p["from_pattern"], to_pattern=p["to_pattern"],
                      min_usd=p["min_usd"], exact=True)


def _tron_contract() -> bytes:
    return b"\x41" + PARAMS["tron"]["token"].encode().rjust(B.ADDRESS_BYTES, b"\x00")


def log_decode_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 leg B: decoded token-transfer logs above the threshold per day."""
    p = PARAMS["tron"]
    out = R.tron_usdt_daily(B.tron_logs(spark, sf_dir), dates=p["dates"],
                            contract=_tron_contract(), topic0=K.ERC20_TRANSFER_TOPIC,
                            min_amount=p["min_transfer"], exact=True)
    return _doubles(out, {"total_volume_m"})


def native_proxy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4v2 leg B: large native transfers per day with estimated USD."""
    p = PARAMS["tron"]
    out = R.tron_native_daily(B.tron_transactions(spark, sf_dir), dates=p["dates"],
                              min_units=p["min_units"], price=p["price"], exact=True)
    return _doubles(out, {"value_usd_m"})


def laundering_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: both laundering channels on one day axis with the daily total."""
    s, t = PARAMS["swaps"], PARAMS["tron"]
    return R.laundering_path(
        B.thorchain_swaps(spark, sf_dir), B.tron_logs(spark, sf_dir), window=s["window"],
        dates=t["dates"], from_pattern=s["from_pattern"], to_pattern=s["to_pattern"],
        min_usd=s["min_usd"], contract=_tron_contract(), topic0=K.ERC20_TRANSFER_TOPIC,
        min_transfer=t["min_transfer"], exact=True)


def laundering_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4v2: swaps and the native-value proxy on one day axis with the daily total."""
    s, t = PARAMS["swaps"], PARAMS["tron"]
    return R.laundering_path_v2(
        B.thorchain_swaps(spark, sf_dir), B.tron_transactions(spark, sf_dir),
        window=s["window"], dates=t["dates"], from_pattern=s["from_pattern"],
        to_pattern=s["to_pattern"], min_usd=s["min_usd"], min_units=t["min_units"],
        price=t["price"], exact=True)


# ------------------------------------------- operators and reports as such -

def watchlist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-5: transfers of one token in the window that touch the watchlist table on either side."""
    p = PARAMS["bridge_drain"]
    origin, suspect = _nation_watchlists(spark, sf_dir)
    contract = p["token"].encode().rjust(B.ADDRESS_BYTES, b"\x00")
    kept = transfers.watchlist_transfers(
        B.erc20_evt_transfer(spark, sf_dir), origin.unionByName(suspect), sender="from", receiver="to",
        contract_col="contract_address", contract=contract, start=p["window"][0], end=p["window"][1])
    return kept.select("block_time", hex_0x("tx_hash").alias("tx_hash"), hex_0x("from").alias("from_addr"),
                       hex_0x("to").alias("to_addr"),
                       round_scaled("value", 18, 2, exact=True).cast("double").alias("amount"))


def net_flow_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-11: deposits minus withdrawals (USD) per day."""
    p = PARAMS["tvl"]
    leg = R.lending_leg(B.lending_supply(spark, sf_dir), window=p["window"], chain="ethereum", project="aave")
    return _doubles(series.net_flow(leg, "block_time", "day", "transaction_type", "amount_usd",
                                    "deposit", "withdraw", "net_usd", bucket="day_bucket"), {"net_usd"})


def merged_moves_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-9: transactions sent by the council, and large ones whose hash is NOT IN those, per day."""
    p = PARAMS["intervention"]
    txs = B.arbitrum_transactions(spark, sf_dir).select("hash", "block_date", "from", "value")
    council = txs.where(F.col("from") == F.lit(p["council_key"].to_bytes(B.ADDRESS_BYTES, "big")))
    large = txs.where(transfers.raw_floor("value", p["route_min"], 18, exact=True))
    merged = transfers.merge_without_duplicates(council, large, "hash")
    return merged.groupBy(F.col("block_date").alias("day_bucket")).agg(
        F.count(F.lit(1)).alias("tx_count"),
        round_scaled(F.sum("value"), 18, 2, exact=True).cast("double").alias("volume"))


def wide_payload_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-17 at 256 bits: per day, payloads above a bound, their exact sum and the greatest, in hex."""
    logs = B.wide_logs(spark, sf_dir)
    kept = logs.where(wide.above_word("data", WIDE_BOUND)).withColumn("raw", wide.limbs("data"))
    daily = series.bucket_flow(kept, "block_time", "date", {
        "payloads": F.count(F.lit(1)), "total": wide.sum_limbs("raw"), "greatest": F.max("raw")}, bucket="day_bucket")
    daily = wide.carry(daily, "total")
    return daily.select("day_bucket", "payloads", wide.to_hex("total", carried=True).alias("total"),
                        wide.to_hex("greatest").alias("greatest"))


#: About half of the payloads are above it.
WIDE_BOUND = (2 ** 64 - 1 - 1000) << 192


def contagion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 as the dashboard shows it: its labels, sorted by hour, with each row's place."""
    p = PARAMS["contagion"]
    report = R.aave_contagion(B.lending_supply(spark, sf_dir), B.lending_borrow(spark, sf_dir),
                              window=p["window"], exact=True)
    return with_position(R.display(report, K.CONTAGION_LABELS))


def intervention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 as the dashboard shows it: labelled, then sorted by two display aliases, with each row's place."""
    shown = R.display(intervention_hourly(spark, sf_dir), K.INTERVENTION_LABELS)
    return with_position(sorted_result(
        shown, K.INTERVENTION_LABELS["hour_bucket"], K.INTERVENTION_LABELS["flow_type"]))


def hourly_legs_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2 in the dashboards' double arithmetic, with sums that no layout changes."""
    p = PARAMS["contagion"]
    supply, borrow = (_doubles(leg(spark, sf_dir), {"amount", "amount_usd"})
                      for leg in (B.lending_supply, B.lending_borrow))
    return R.aave_contagion(supply, borrow, window=p["window"])


def written_hop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the hop log written as a result table and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/hop-log-{uuid.uuid4().hex}"
    write_result(hop_log(spark, sf_dir), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- Q5 ------

def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 / OP-19: numbered flow edges with each edge's percent of the total."""
    edges = graph.number_edges(B.nation_flow_edges(spark, sf_dir))
    out = graph.flow_edges(edges, value="value_usd_m", out="pct_of_total")
    return _doubles(out.select("step", "source_node", "target_node", "value_usd_m",
                               "pct_of_total"), {"value_usd_m"})


def node_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-20: per node and direction, the summed edge value."""
    out = graph.node_totals(B.nation_flow_edges(spark, sf_dir), value="value_usd_m")
    return _doubles(out, {"total"})


def fund_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-1: nodes holding more than they sent, with the surplus."""
    out = graph.fund_destinations(B.nation_flow_edges(spark, sf_dir), value="value_usd_m")
    return _doubles(out, {"resting_value"})


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RD-2: resting value split into recovered and at-risk nodes."""
    out = graph.recovery(B.nation_flow_edges(spark, sf_dir), PARAMS["recovered_nodes"],
                         value="value_usd_m")
    return _doubles(out, {"amount"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hop_log": hop_log,
    "bridge_drain": bridge_drain,
    "severity_profile": severity_profile,
    "address_display": address_display,
    "hourly_legs": hourly_legs,
    "daily_net_flow": daily_net_flow,
    "intervention_hourly": intervention_hourly,
    "swap_log": swap_log,
    "swap_daily": swap_daily,
    "swap_daily_rounded_rows": swap_daily_rounded_rows,
    "log_decode_daily": log_decode_daily,
    "native_proxy_daily": native_proxy_daily,
    "laundering_v1": laundering_v1,
    "laundering_v2": laundering_v2,
    "flow_edges": flow_edges,
    "node_totals": node_totals,
    "fund_destinations": fund_destinations,
    "recovery": recovery,
    "peak_bucket": peak_bucket,
    "leverage_ratio": leverage_ratio,
    "primary_drain": primary_drain,
    "dispersion": dispersion,
    "watchlist_log": watchlist_log,
    "net_flow_daily": net_flow_daily,
    "merged_moves_daily": merged_moves_daily,
    "wide_payload_daily": wide_payload_daily,
    "contagion_report": contagion_report,
    "intervention_report": intervention_report,
    "hourly_legs_double": hourly_legs_double,
}

#: Queries that write a table when they are built.
SINKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "written_hop_log": written_hop_log,
}

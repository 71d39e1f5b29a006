"""The eight incident dashboards as Spark pipelines.

Each recipe takes the source tables as DataFrames with the column names of
the chain tables (``FIXTURES.md``), composes the operators, and returns a
snake_case result; :func:`display` maps it to the dashboard labels. Every
address, threshold, price and window is a parameter whose default is the
dashboards' fixed value (:mod:`flowtrace.plans.constants`).

``exact=True`` keeps raw integer amounts end to end: thresholds, sums and
running totals are taken on the ``decimal(38,0)`` integers, and reports round
and scale once (doubles only at the very end).
``exact=False`` follows the dashboards' double arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.double_sum import sum_of
from ..functions.predicates import between_closed, partition_bound, window_predicate
from ..functions.scalars import hex_0x, hex_upper, lit_number, round_scaled, shorten
from ..operators import channels, findings, graph, series, transfers
from ..operators.membership import member_condition
from ..operators.ordered import sorted_result
from . import constants as K


def _final(c: Column, exact: bool) -> Column:
    """Decimals become doubles only at the end of an exact pipeline."""
    return c.cast("double") if exact else c


def _bound(value, exact: bool, decimals: int):
    """A threshold in the unit of ``amount``: raw integers in exact mode."""
    return Decimal(str(value)).scaleb(decimals) if exact else value


def _shown(c, digits: int, exact: bool, decimals: int, power: int = 0) -> Column:
    """ROUND(c / 10^power, digits) of an amount; exact amounts are raw
    integers, rounded and scaled here in one step."""
    if exact:
        return round_scaled(c, decimals + power, digits, True)
    return round_scaled(c, power, digits) if power else F.round(c, digits)


def display(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """PRJ-6: rename snake_case columns to dashboard labels (in order)."""
    return df.select(*[F.col(c).alias(labels.get(c, c)) for c in df.columns])


# --------------------------------------------------------------------------
# Q1: the inception hop log
# --------------------------------------------------------------------------

def inception_hop_log(rseth_transfers: DataFrame, *, dates=K.HOP_LOG_DATES,
                      min_amount=K.HOP_MIN_RSETH, price=K.RSETH_PRICE_HOP_LOG,
                      bounds=K.SEVERITY_BOUNDS, labels=K.SEVERITY_LABELS,
                      decimals: int = 18, exact: bool = False, sort: bool = True) -> DataFrame:
    """Transfers above ``min_amount`` in a closed date window, numbered in
    time order with a severity tier and a running total.

    Source columns: ``evt_tx_hash, evt_index, evt_block_time,
    evt_block_number, from, to, value, evt_block_date`` (partitioned by
    ``evt_block_date``)."""
    tiered = _hop_rows(rseth_transfers, dates, min_amount, price, bounds, labels, decimals, exact)
    hops = transfers.hop_log(tiered, _bound(min_amount, exact, decimals), order_by=HOP_ORDER,
                             seq_out="hop_sequence", cum_out="_cum")
    out = _hop_report(hops, decimals, exact)
    return sorted_result(out, "hop_sequence") if sort else out


#: The log index makes the order of hops total.
HOP_ORDER = ("block_time", "tx_hash", "evt_index")


def _hop_rows(rseth_transfers, dates, min_amount, price, bounds, labels, decimals, exact) -> DataFrame:
    """Transfers of the window above the threshold with their tier."""
    scoped = rseth_transfers.where(between_closed("evt_block_date", *dates)
                                   & transfers.raw_floor("value", min_amount, decimals, exact))
    canon = transfers.normalize_transfers(
        scoped, tx_hash="evt_tx_hash", block_time="evt_block_time",
        block_number="evt_block_number", sender="from", receiver="to", value="value",
        block_date="evt_block_date", decimals=0 if exact else decimals, price=price, exact=exact,
        extra=["evt_index"])
    return transfers.severity_tier(
        canon, "amount", [_bound(b, exact, decimals) for b in bounds], labels)


def _hop_report(hops: DataFrame, decimals: int, exact: bool) -> DataFrame:
    """The dashboard's columns of numbered hops."""
    return hops.select(
        "hop_sequence", "block_time", "block_number",
        hex_upper("tx_hash").alias("tx_hash"),
        hex_0x("sender").alias("from_address"),
        hex_0x("receiver").alias("to_address"),
        _final(_shown("amount", 4, exact, decimals), exact).alias("rseth_amount"),
        _final(_shown("usd", 3, exact, decimals, 6), exact).alias("usd_value_m"),
        _final(_shown("_cum", 2, exact, decimals), exact).alias("cumulative_rseth_drained"),
        F.col("transfer_type").alias("classification"))


def primary_drain(rseth_transfers: DataFrame, *, dates=K.HOP_LOG_DATES,
                  min_amount=K.HOP_MIN_RSETH, price=K.RSETH_PRICE_HOP_LOG,
                  bounds=K.SEVERITY_BOUNDS, labels=K.SEVERITY_LABELS,
                  decimals: int = 18, exact: bool = False) -> DataFrame:
    """RD-5: the hop log's row with the greatest amount (the earliest of
    equals), without numbering the others: two aggregates over raw rows."""
    tiered = _hop_rows(rseth_transfers, dates, min_amount, price, bounds, labels, decimals, exact)
    hops = transfers.above(tiered, "amount", _bound(min_amount, exact, decimals))
    found = findings.largest_with_place(hops, "amount", HOP_ORDER, "hop_sequence", "_cum")
    return _hop_report(found, decimals, exact)


HOP_LOG_LABELS = K.HOP_LOG_LABELS


# --------------------------------------------------------------------------
# Q1b: bridge drain transactions
# --------------------------------------------------------------------------

def bridge_drain(erc20_transfers: DataFrame, *, contract=K.RSETH_ERC20,
                 origin=K.BRIDGE_ORIGIN, suspect=K.ATTACKER_WALLET,
                 window=K.BRIDGE_DRAIN_WINDOW, price=K.RSETH_PRICE_BRIDGE_DRAIN,
                 labels=K.ROLE_LABELS, decimals: int = 18, exact: bool = False,
                 sort: bool = True) -> DataFrame:
    """Transfers of one token touching the bridge or the attacker in a
    half-open time window, with a role and the running total drained by
    exploit rows (peers on ``(block_time, tx_hash)`` share a total).

    Source columns: ``block_time, tx_hash, from, to, value,
    contract_address, block_date`` (its partition key). ``origin``/``suspect`` are addresses, lists or
    one-column watchlist tables."""
    scoped = erc20_transfers.where(partition_bound("block_date", window[0], "date", window[1]))
    scoped = transfers.in_window(scoped, "block_time", window[0], window[1])
    scoped = scoped.where(F.col("contract_address") == F.lit(contract))
    canon = transfers.normalize_transfers(
        scoped, tx_hash="tx_hash", block_time="block_time", sender="from", receiver="to",
        value="value", decimals=0 if exact else decimals, price=price, exact=exact)
    roled = transfers.watchlist_roles(canon, origin, suspect, labels)
    prog = transfers.drain_progress(roled, "transfer_type", labels[0],
                                    order_by=("block_time", "tx_hash"), out="_cum")
    out = prog.select(
        "block_time",
        shorten(hex_0x("tx_hash"), 18).alias("tx_hash_short"),
        hex_0x("tx_hash").alias("tx_hash_full"),
        shorten(hex_0x("sender"), 10).alias("from_addr"),
        shorten(hex_0x("receiver"), 10).alias("to_addr"),
        _final(_shown("amount", 2, exact, decimals), exact).alias("amount_rseth"),
        _final(_shown("usd", 0, exact, decimals), exact).alias("amount_usd"),
        "transfer_type",
        _final(_shown("_cum", 2, exact, decimals), exact).alias("cumulative_drained_rseth"))
    # Sorted by the running total's own order (the dashboard sorts by time
    # only, which leaves rows of one block in arbitrary order).
    return sorted_result(out, "block_time", "tx_hash_full") if sort else out


# --------------------------------------------------------------------------
# Q2: Aave contagion (hourly collateral vs borrow)
# --------------------------------------------------------------------------

def lending_leg(events: DataFrame, *, window, chain: str, project: str,
                symbols: Sequence[str] | None = None, types: Sequence[str] | None = None
                ) -> DataFrame:
    """Filtered lending events: chain, project, optional symbols/types and a
    half-open time window, plus the implied ``block_month`` bound so the
    scan prunes month partitions."""
    cond = ((F.col("blockchain") == F.lit(chain)) & (F.col("project") == F.lit(project))
            & partition_bound("block_month", window[0], "month", window[1])
            & window_predicate("block_time", window[0], window[1]))
    if symbols is not None:
        cond = cond & F.col("symbol").isin(list(symbols))
    if types is not None:
        cond = cond & F.col("transaction_type").isin(list(types))
    return events.where(cond)


def aave_contagion(supply: DataFrame, borrow: DataFrame, *, window=K.CONTAGION_WINDOW,
                   chain: str = "ethereum", project: str = "aave",
                   collateral_symbols=("rsETH",), borrow_symbols=("ETH", "WETH"),
                   supply_types=None, exact: bool = False, sort: bool = True) -> DataFrame:
    """Hourly collateral supplied vs ETH borrowed, aligned on one hour axis,
    with the cumulative borrow. ``supply_types=None`` sums every supply type
    like the dashboard; pass ``("deposit",)`` for deposits only."""
    s = lending_leg(supply, window=window, chain=chain, project=project,
                    symbols=collateral_symbols, types=supply_types)
    b = lending_leg(borrow, window=window, chain=chain, project=project,
                    symbols=borrow_symbols)
    # Both legs bucketed and aligned by one aggregate over the stacked rows.
    aligned = series.bucket_legs([
        (s, "block_time", {"rseth_supplied": ("sum", "amount"),
                           "rseth_supplied_usd": ("sum", "amount_usd"),
                           "supply_tx_count": ("count", None)}),
        (b, "block_time", {"eth_borrowed": ("sum", "amount"),
                           "eth_borrowed_usd": ("sum", "amount_usd"),
                           "borrow_tx_count": ("count", None)})], "hour", "hour_bucket")
    cum = series.running_total(aligned, "eth_borrowed", "_cum", ["hour_bucket"], frame="rows")
    out = cum.select(
        "hour_bucket",
        _final(F.round("rseth_supplied", 2), exact).alias("rseth_supplied"),
        _final(round_scaled("rseth_supplied_usd", 6, 3, exact), exact)
        .alias("rseth_supply_usd_m"),
        _final(F.round("eth_borrowed", 2), exact).alias("eth_weth_borrowed"),
        _final(round_scaled("eth_borrowed_usd", 6, 3, exact), exact)
        .alias("eth_borrow_usd_m"),
        _final(F.round("_cum", 2), exact).alias("cumul_eth_borrowed"))
    return sorted_result(out, "hour_bucket") if sort else out


# --------------------------------------------------------------------------
# Q2b: Aave daily net flows
# --------------------------------------------------------------------------

def aave_tvl_drop(supply: DataFrame, borrow: DataFrame, *, window=K.TVL_WINDOW,
                  pivot=K.HACK_DAY, chain: str = "ethereum", project: str = "aave",
                  labels=K.PERIOD_LABELS, exact: bool = False, sort: bool = True
                  ) -> DataFrame:
    """Daily net supply (deposits - withdrawals) and net borrow (borrows -
    repays) in USD billions, the cumulative net supply since the window
    start, and a pre/hack-day/post flag."""
    s = lending_leg(supply, window=window, chain=chain, project=project)
    b = lending_leg(borrow, window=window, chain=chain, project=project)
    aligned = series.bucket_legs([
        (s, "block_time", {"net_supply_usd": ("sum", series.signed_amount(
            "transaction_type", "amount_usd", "deposit", "withdraw"))}),
        (b, "block_time", {"net_borrow_usd": ("sum", series.signed_amount(
            "transaction_type", "amount_usd", "borrow", "repay"))})], "day", "day_bucket")
    cum = series.running_total(aligned, "net_supply_usd", "_cum", ["day_bucket"], frame="rows")
    flagged = series.period_flag(cum, "day_bucket", pivot, labels)
    out = flagged.select(
        "day_bucket",
        _final(round_scaled("net_supply_usd", 9, 3, exact), exact)
        .alias("net_supply_change_b"),
        _final(round_scaled("net_borrow_usd", 9, 3, exact), exact)
        .alias("net_borrow_change_b"),
        _final(round_scaled("_cum", 9, 3, exact), exact).alias("cumulative_net_supply_b"),
        "period_flag")
    return sorted_result(out, "day_bucket") if sort else out


# --------------------------------------------------------------------------
# Q3: Arbitrum intervention
# --------------------------------------------------------------------------

def arbitrum_intervention(txs: DataFrame, *, council=K.ARBITRUM_SECURITY_COUNCIL,
                          executor=K.ARBITRUM_EMERGENCY_EXECUTOR,
                          council_dates=K.COUNCIL_DATES, route_dates=K.ROUTE_DATES,
                          council_min=K.COUNCIL_MIN_ETH, route_min=K.ROUTE_MIN_ETH,
                          price=K.ETH_PRICE, labels=K.DIRECTION_LABELS,
                          route_label=K.ROUTE_LABEL, decimals: int = 18,
                          exact: bool = False, unit: str = "hour",
                          sort: bool = True) -> DataFrame:
    """Watched-address activity plus large moves (minus transactions already
    in the watched leg, NOT IN semantics), counted and summed per hour and
    flow type, with a per-flow running total of the rounded volumes.

    Source columns: ``block_time, block_number, hash, from, to, value,
    block_date, success`` (partitioned by ``block_date``)."""
    # One pass over the table for both legs (the dashboard scans it twice):
    # rows of either leg are selected together and tagged; a window over the
    # transaction hash then drops route rows of watched transactions.
    units = 0 if exact else decimals
    c_win = between_closed("block_date", *council_dates)
    r_win = between_closed("block_date", *route_dates)
    watch = [council, executor]
    scoped = txs.where((c_win | r_win) & transfers.raw_floor(
        "value", min(council_min, route_min), decimals, exact))
    scoped, watched_from = member_condition(scoped, "from", watch)
    scoped, watched_to = member_condition(scoped, "to", watch)
    scoped = scoped.withColumn("_watched", c_win & (watched_from | watched_to)) \
                   .withColumn("_routed", r_win)
    canon = transfers.normalize_transfers(
        scoped, tx_hash="hash", block_time="block_time", block_number="block_number",
        sender="from", receiver="to", value="value", block_date="block_date",
        decimals=units, exact=exact, extra=["success", "_watched", "_routed"])
    legs = transfers.large_moves(canon, _bound(min(council_min, route_min), exact, decimals))
    legs = legs.withColumn("_watched", F.col("_watched") & (
        F.col("amount") > F.lit(_bound(council_min, exact, decimals)))) \
        .withColumn("_routed", F.col("_routed") & (
            F.col("amount") > F.lit(_bound(route_min, exact, decimals))))
    moves = transfers.merge_tagged(legs.where("_watched or _routed"), "_watched", "_routed", "tx_hash")
    moves = transfers.flow_direction(moves, council, labels)
    moves = moves.withColumn("flow_direction", F.when(F.col("_watched"), F.col("flow_direction"))
                             .otherwise(F.lit(route_label)))
    hourly = series.bucket_flow(moves, "block_time", unit, {
        "tx_count": F.count(F.lit(1)), "_sum": sum_of(moves, "amount")},
        keys=["flow_direction"], bucket="hour_bucket")
    hourly = hourly.select(
        "hour_bucket", "flow_direction", "tx_count",
        _shown("_sum", 4, exact, decimals).alias("eth_volume"),
        _shown(F.col("_sum") * lit_number(price, exact), 3, exact, decimals, 6)
        .alias("usd_volume_m"))
    cum = series.running_total(hourly, "eth_volume", "_cum", ["hour_bucket"],
                               partition_by=["flow_direction"], frame="rows")
    out = cum.select(
        "hour_bucket", F.col("flow_direction").alias("flow_type"), "tx_count",
        _final(F.col("eth_volume"), exact).alias("eth_volume"),
        _final(F.col("usd_volume_m"), exact).alias("usd_volume_m"),
        _final(F.round("_cum", 4), exact).alias("cumulative_eth"))
    return sorted_result(out, "hour_bucket", "flow_type") if sort else out


# --------------------------------------------------------------------------
# Q4 / Q4v2: laundering path
# --------------------------------------------------------------------------

def thorchain_daily(swaps: DataFrame, *, window=K.LAUNDERING_WINDOW,
                    from_pattern: str = "%ETH%", to_pattern: str = "%BTC%",
                    min_usd=K.SWAP_MIN_USD, round_rows: bool = False,
                    exact: bool = False) -> DataFrame:
    """Large ETH->BTC swaps per day (v2 sums then rounds; v1,
    ``round_rows=True``, rounds every swap first)."""
    big = channels.large_swaps(swaps.where(partition_bound("block_date", window[0], "date", window[1])), from_pattern=from_pattern, to_pattern=to_pattern,
                               min_usd=min_usd, time_col="block_timestamp",
                               start=window[0], end=window[1])
    return channels.swap_daily(big, round_rows=round_rows, exact=exact)


def swap_log(swaps: DataFrame, *, window=K.LAUNDERING_WINDOW, from_pattern: str = "%ETH%",
             to_pattern: str = "%BTC%", min_usd=K.SWAP_MIN_USD, label=K.SWAP_ROUTE_LABEL,
             exact: bool = False) -> DataFrame:
    """Rows behind :func:`thorchain_daily` of v1: every large swap with its
    route label and its rounded amounts."""
    big = channels.large_swaps(swaps.where(partition_bound("block_date", window[0], "date", window[1])),
                               from_pattern=from_pattern, to_pattern=to_pattern,
                               min_usd=min_usd, time_col="block_timestamp",
                               start=window[0], end=window[1])
    return big.select(
        "block_timestamp", "tx_id", "from_address", "from_asset", "to_asset",
        F.lit(label).alias("route"), _final(F.round("from_amount", 4), exact).alias("amount_sent"),
        _final(F.round("to_amount", 4), exact).alias("amount_received"),
        _final(F.round("from_amount_usd", 2), exact).alias("swap_usd"))


def tron_usdt_daily(logs: DataFrame, *, dates=K.LAUNDERING_DATES,
                    contract=K.TRON_USDT_CONTRACT, topic0=K.ERC20_TRANSFER_TOPIC,
                    min_amount=K.USDT_MIN_TRANSFER, decimals: int = 6,
                    exact: bool = False) -> DataFrame:
    """Decoded USDT Transfer logs above ``min_amount`` per day."""
    decoded = channels.decode_token_transfers(logs, contract=contract, topic0=topic0,
                                              decimals=decimals, exact=exact,
                                              min_amount=min_amount if exact else None,
                                              start=dates[0], end=dates[1])
    return channels.large_transfer_daily(decoded, None if exact else min_amount, exact=exact,
                                         decimals=decimals)


def tron_native_daily(txs: DataFrame, *, dates=K.LAUNDERING_DATES,
                      min_units=K.TRX_MIN_UNITS, price=K.TRX_PRICE, decimals: int = 6,
                      exact: bool = False) -> DataFrame:
    """Large native TRX transfers per day with an estimated USD value."""
    return channels.native_value_proxy(txs, min_units=min_units, price=price,
                                       decimals=decimals, exact=exact,
                                       start=dates[0], end=dates[1])


def laundering_path(swaps: DataFrame, tron_logs: DataFrame, *,
                    window=K.LAUNDERING_WINDOW, dates=K.LAUNDERING_DATES,
                    from_pattern: str = "%ETH%", to_pattern: str = "%BTC%",
                    min_usd=K.SWAP_MIN_USD, contract=K.TRON_USDT_CONTRACT,
                    topic0=K.ERC20_TRANSFER_TOPIC, min_transfer=K.USDT_MIN_TRANSFER,
                    exact: bool = False, sort: bool = True) -> DataFrame:
    """Q4: ThorChain swaps (rounded per swap) and decoded Tron USDT transfers
    on one day axis, with the combined daily total."""
    # Each channel is aggregated on its own and the per-day results are
    # aligned by one full outer join (both sides are one row per day). For
    # these join-fed legs this measured faster than stacking their rows into
    # one aggregate (``series.bucket_legs``), which the lending series use.
    tc = thorchain_daily(swaps, window=window, from_pattern=from_pattern,
                         to_pattern=to_pattern, min_usd=min_usd, round_rows=True, exact=exact)
    tu = tron_usdt_daily(tron_logs, dates=dates, contract=contract, topic0=topic0,
                         min_amount=min_transfer, exact=exact)
    aligned = series.align_legs([tc, tu], "day_bucket")
    total = channels.combine_channels(aligned, ["total_swap_usd_m", "total_volume_m"], "_tot")
    out = total.select(
        "day_bucket",
        F.col("swap_count").alias("thorchain_swap_count"),
        _final(F.col("total_sent"), exact).alias("eth_to_btc"),
        _final(F.col("total_received"), exact).alias("btc_received"),
        _final(F.col("total_swap_usd_m"), exact).alias("thorchain_volume_m"),
        F.col("transfer_count").alias("tron_usdt_transfers"),
        _final(F.col("total_volume_m"), exact).alias("tron_usdt_volume_m"),
        _final(F.col("_tot"), exact).alias("total_laundered_m"))
    return sorted_result(out, "day_bucket") if sort else out


def laundering_path_v2(swaps: DataFrame, tron_txs: DataFrame, *,
                       window=K.LAUNDERING_WINDOW, dates=K.LAUNDERING_DATES,
                       from_pattern: str = "%ETH%", to_pattern: str = "%BTC%",
                       min_usd=K.SWAP_MIN_USD, min_units=K.TRX_MIN_UNITS,
                       price=K.TRX_PRICE, exact: bool = False, sort: bool = True
                       ) -> DataFrame:
    """Q4v2: ThorChain swaps (summed, then rounded) and the native TRX proxy
    on one day axis, with the combined daily total."""
    tc = thorchain_daily(swaps, window=window, from_pattern=from_pattern,
                         to_pattern=to_pattern, min_usd=min_usd, round_rows=False, exact=exact)
    tn = tron_native_daily(tron_txs, dates=dates, min_units=min_units, price=price,
                           exact=exact)
    aligned = series.align_legs([tc, tn], "day_bucket")
    total = channels.combine_channels(aligned, ["total_swap_usd_m", "value_usd_m"], "_tot")
    out = total.select(
        "day_bucket",
        F.col("swap_count").alias("thorchain_swaps"),
        _final(F.col("total_sent"), exact).alias("eth_swapped"),
        _final(F.col("total_received"), exact).alias("btc_received"),
        _final(F.col("total_swap_usd_m"), exact).alias("thorchain_volume_m"),
        F.col("tx_count").alias("tron_large_tx_count"),
        _final(F.col("value_usd_m"), exact).alias("tron_value_usd_m"),
        _final(F.col("_tot"), exact).alias("total_laundering_flow_m"))
    return sorted_result(out, "day_bucket") if sort else out


# --------------------------------------------------------------------------
# Q5: kill-chain flow summary
# --------------------------------------------------------------------------

EDGE_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType(), False),
    T.StructField("source_node", T.StringType(), False),
    T.StructField("target_node", T.StringType(), False),
    T.StructField("value_usd_m", T.DecimalType(4, 1), False),
    T.StructField("notes", T.StringType(), False),
])


def kill_chain_edges(spark: SparkSession, rows=None) -> DataFrame:
    """SRC-9: the dashboards' nine literal edges as a DataFrame."""
    rows = rows if rows is not None else K.KILL_CHAIN_EDGES
    data = [(s, a, b, Decimal(v), n) for s, a, b, v, n in rows]
    return spark.createDataFrame(data, EDGE_SCHEMA)


def kill_chain_summary(edges: DataFrame, *, total=K.EXPLOIT_TOTAL_USD_M,
                       value: str = "value_usd_m", sort: bool = True) -> DataFrame:
    """Edge table with each edge's percent of the exploit total."""
    out = graph.flow_edges(edges, value=value, total=total, out="pct_of_total")
    out = out.select("step", "source_node", "target_node", value, "notes", "pct_of_total")
    return sorted_result(out, "step") if sort else out

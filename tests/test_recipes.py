"""The dashboards' recipes with their own fixed values on small chain-table
fixtures (the reference ships no data; these rows are built to hit each
branch)."""

import datetime as dt
from decimal import Decimal

from flowtrace.plans import constants as K
from flowtrace.plans import recipes as R
from flowtrace.sources.tables import SCHEMAS

E18 = Decimal(10) ** 18
X = b"\x77" * 20
H = [bytes([i]) * 32 for i in range(16)]


def ts(day, h, m=0):
    return dt.datetime(2026, 4, day, h, m)


def test_inception_hop_log_defaults(spark):
    rows = [(H[1], ts(18, 17, 30), 24908200, K.BRIDGE_ORIGIN, X, 50 * E18),
            (H[2], ts(18, 17, 37), 24908285, K.BRIDGE_ORIGIN, K.ATTACKER_WALLET, 116500 * E18),
            (H[3], ts(18, 17, 40), 24908300, K.ATTACKER_WALLET, X, 20000 * E18),
            (H[4], ts(18, 17, 45), 24908320, X, K.ATTACKER_WALLET, 5000 * E18),
            (H[5], ts(19, 1, 0), 24910000, X, X, 500 * E18),
            (H[6], ts(20, 1, 0), 24920000, X, X, 300 * E18)]
    df = spark.createDataFrame([(r[0], i) + r[1:] + (r[1].date(),) for i, r in enumerate(rows)],
                               SCHEMAS["rseth_evt_transfer"])
    out = R.inception_hop_log(df).collect()
    assert [(r.hop_sequence, r.rseth_amount, r.cumulative_rseth_drained) for r in out] == [
        (1, 116500.0, 116500.0), (2, 20000.0, 136500.0), (3, 5000.0, 141500.0),
        (4, 500.0, 142000.0)]
    assert out[0].usd_value_m == 291.949 and out[0].block_number == 24908285
    assert out[0].from_address == "0x85d456b2dff1fd8245387c0bfb64dfb700e98ef3"
    assert [r.classification for r in out] == list(K.SEVERITY_LABELS)
    labelled = R.display(R.inception_hop_log(df), R.HOP_LOG_LABELS)
    assert labelled.columns[0] == "Hop #" and "Cumul. rsETH Drained" in labelled.columns


def test_bridge_drain_defaults(spark):
    t0 = ts(18, 17, 0)
    rows = [(t0, H[1], K.BRIDGE_ORIGIN, K.ATTACKER_WALLET, 100000 * E18, K.RSETH_ERC20),
            (t0, H[1], K.BRIDGE_ORIGIN, K.ATTACKER_WALLET, 16500 * E18, K.RSETH_ERC20),
            (ts(18, 18), H[2], K.ATTACKER_WALLET, X, 1000 * E18, K.RSETH_ERC20),
            (ts(18, 19), H[3], X, K.BRIDGE_ORIGIN, 1 * E18, K.RSETH_ERC20),
            (ts(18, 19), H[4], X, X, 7 * E18, K.RSETH_ERC20),            # not watched
            (ts(18, 20), H[5], K.BRIDGE_ORIGIN, K.ATTACKER_WALLET, E18, X),  # other token
            (ts(19, 6), H[6], K.BRIDGE_ORIGIN, K.ATTACKER_WALLET, E18, K.RSETH_ERC20)]
    df = spark.createDataFrame([r + (r[0].date(),) for r in rows],
                               SCHEMAS["erc20_evt_transfer"])
    out = R.bridge_drain(df).collect()
    assert [(r.transfer_type, r.cumulative_drained_rseth) for r in out] == [
        (K.ROLE_LABELS[0], 116500.0), (K.ROLE_LABELS[0], 116500.0),
        (K.ROLE_LABELS[1], 116500.0), (K.ROLE_LABELS[2], 116500.0)]
    assert out[0].from_addr == "0x85d456b2..." and out[0].tx_hash_short.endswith("...")
    assert sorted(r.amount_usd for r in out[:2]) == [41357250.0, 250650000.0]


def _lending(spark, rows):
    return spark.createDataFrame(
        [(t, t.date().replace(day=1), "ethereum", "aave", s, ty, a, a * 2506.0)
         for t, s, ty, a in rows], SCHEMAS["lending_supply"])


def test_aave_contagion_and_tvl_defaults(spark):
    supply = _lending(spark, [(ts(18, 17, 5), "rsETH", "deposit", 53400.0),
                              (ts(18, 18, 0), "rsETH", "deposit", 63100.0),
                              (ts(17, 3, 0), "rsETH", "withdraw", 100.0),
                              (ts(18, 17, 9), "USDC", "deposit", 5.0)])
    borrow = _lending(spark, [(ts(18, 17, 30), "WETH", "borrow", 51576.0),
                              (ts(18, 19, 0), "ETH", "borrow", 24224.0),
                              (ts(19, 2, 0), "ETH", "repay", 1000.0),
                              (ts(18, 19, 0), "USDC", "borrow", 9.0)])
    hourly = R.aave_contagion(supply, borrow).collect()
    assert [(r.hour_bucket.hour, r.rseth_supplied, r.eth_weth_borrowed, r.cumul_eth_borrowed)
            for r in hourly] == [(3, 100.0, 0.0, 0.0), (17, 53400.0, 51576.0, 51576.0),
                                 (18, 63100.0, 0.0, 51576.0), (19, 0.0, 24224.0, 75800.0),
                                 (2, 0.0, 1000.0, 76800.0)]
    daily = R.aave_tvl_drop(supply, borrow).collect()
    assert [r.period_flag for r in daily] == [K.PERIOD_LABELS[2], K.PERIOD_LABELS[0],
                                              K.PERIOD_LABELS[1]]


def test_arbitrum_intervention_defaults(spark):
    c, e = K.ARBITRUM_SECURITY_COUNCIL, K.ARBITRUM_EMERGENCY_EXECUTOR
    d = dt.date(2026, 4, 18)
    rows = [(ts(18, 20), 1, H[1], X, c, 30766 * E18, d, True),     # council + large: once
            (ts(18, 21), 2, H[2], c, X, 20 * E18, d, True),
            (ts(18, 21), 3, H[3], e, X, 15 * E18, d, True),
            (ts(18, 22), 4, H[4], X, X, 2000 * E18, d, True),
            (ts(18, 22), 5, H[5], X, X, 5000 * E18, d, False),
            (ts(18, 23), 6, H[6], c, X, 1 * E18, d, True)]             # dust
    df = spark.createDataFrame(rows, SCHEMAS["arbitrum_transactions"])
    out = {(r.hour_bucket.hour, r.flow_type): (r.tx_count, r.eth_volume, r.cumulative_eth)
           for r in R.arbitrum_intervention(df).collect()}
    L = K.DIRECTION_LABELS
    assert out == {(20, L[0]): (1, 30766.0, 30766.0), (21, L[1]): (1, 20.0, 20.0),
                   (21, L[2]): (1, 15.0, 15.0), (22, K.ROUTE_LABEL): (1, 2000.0, 2000.0)}


def test_laundering_paths_defaults(spark):
    swaps = spark.createDataFrame(
        [r + (r[0].date(),) for r in (
            (ts(19, 1), "a", "x", "ETH.ETH", "BTC.BTC", 100.00004, 3.00004, 1000000.004),
            (ts(19, 2), "b", "x", "ETH.ETH", "BTC.BTC", 50.0, 1.5, 499999.0),
            (ts(20, 2), "c", "x", "ETH.USDC", "BTC.BTC", 10.0, 0.5, 600000.0))],
        SCHEMAS["thorchain_swaps"])
    d19 = dt.date(2026, 4, 19)
    word = (3_000_000 * 10 ** 6).to_bytes(32, "big")
    logs = spark.createDataFrame(
        [(ts(19, 5), d19, H[1], X, X, word, K.TRON_USDT_CONTRACT, K.ERC20_TRANSFER_TOPIC),
         (ts(21, 5), dt.date(2026, 4, 21), H[2], X, X, word, K.TRON_USDT_CONTRACT,
          K.ERC20_TRANSFER_TOPIC)], SCHEMAS["tron_logs"])
    v1 = {r.day_bucket: r for r in R.laundering_path(swaps, logs).collect()}
    assert v1[d19].thorchain_swap_count == 1 and v1[d19].tron_usdt_transfers == 1
    assert v1[d19].total_laundered_m == round(1.0 + 3.0, 3)
    assert v1[dt.date(2026, 4, 21)].thorchain_swap_count == 0
    txs = spark.createDataFrame([(d19, Decimal(2_532_000 * 10 ** 6), True)],
                                SCHEMAS["tron_transactions"])
    v2 = {r.day_bucket: r for r in R.laundering_path_v2(swaps, txs).collect()}
    assert v2[d19].tron_large_tx_count == 1 and v2[d19].tron_value_usd_m == 0.304


def test_display_labels_cover_each_dashboard(spark):
    from flowtrace.sources import bindings as B
    from flowtrace.plans.bound import PARAMS
    sf = "/root/testdata/sf0.001"
    s, t = PARAMS["swaps"], PARAMS["tron"]
    cases = [
        (R.aave_contagion(B.lending_supply(spark, sf), B.lending_borrow(spark, sf),
                          window=PARAMS["contagion"]["window"]), K.CONTAGION_LABELS),
        (R.aave_tvl_drop(B.lending_supply(spark, sf), B.lending_borrow(spark, sf),
                         window=PARAMS["tvl"]["window"], pivot=PARAMS["tvl"]["pivot"]),
         K.TVL_LABELS),
        (R.laundering_path_v2(B.thorchain_swaps(spark, sf), B.tron_transactions(spark, sf),
                              window=s["window"], dates=t["dates"],
                              from_pattern=s["from_pattern"], to_pattern=s["to_pattern"],
                              min_usd=s["min_usd"], min_units=t["min_units"]),
         K.LAUNDERING_V2_LABELS),
        (R.kill_chain_summary(R.kill_chain_edges(spark)), K.KILL_CHAIN_LABELS),
    ]
    for df, labels in cases:
        shown = R.display(df, labels)
        assert shown.columns == list(labels.values())
        assert shown.count() > 0
    for labels in (K.INTERVENTION_LABELS, K.LAUNDERING_LABELS, K.HOP_LOG_LABELS):
        assert len(set(labels.values())) == len(labels)

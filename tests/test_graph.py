from pyspark.sql import functions as F

from flowtrace.operators import fund_destinations, node_balances, node_totals, recovery
from flowtrace.plans import constants as K
from flowtrace.plans.recipes import kill_chain_edges, kill_chain_summary


def test_percent_of_total(spark):
    edges = kill_chain_edges(spark)
    pct = {r.step: r.pct_of_total for r in kill_chain_summary(edges).collect()}
    assert pct[1] == 100.0 and pct[3] == 65.1 and pct[4] == 26.4 and pct[9] == 17.4


def test_fund_destinations_on_kill_chain(spark):
    edges = kill_chain_edges(spark)
    dest = {r.node: float(r.resting_value)
            for r in fund_destinations(edges, value="value_usd_m").collect()}
    assert dest == {"Security Council Freeze": 77.1, "Cold BTC Storage (Lazarus)": 50.9,
                    "Tron USDT (TR7NH...)": 62.0, "Aave v3 Ethereum (Collateral)": 102.0}


def test_recovery_accounting(spark):
    out = {r.status: float(r.amount) for r in
           recovery(kill_chain_edges(spark), K.RECOVERED_NODES, value="value_usd_m").collect()}
    assert out == {"recovered": 77.1, "at_risk": 214.9}


def test_interior_nodes_conserve_flow(spark):
    edges = kill_chain_edges(spark)
    bal = {r.node: (float(r.total_in), float(r.total_out)) for r in
           node_balances(edges, value="value_usd_m").collect()}
    for node in ("Attacker Wallet (Lazarus)", "Attacker Wallet (ETH/WETH)", "Arbitrum Bridge",
                 "ThorChain Router (Ethereum)", "Bitcoin Wallets (BTC)"):
        assert round(bal[node][0], 1) == round(bal[node][1], 1)
    totals = node_totals(edges, value="value_usd_m")
    assert totals.where(F.col("direction") == "out").count() == 7
    assert totals.where(F.col("direction") == "in").count() == 9
    assert len(bal) == 10  # ten distinct nodes in nine edges



def test_findings_on_empty_input_return_no_row(spark):
    from flowtrace.operators import peak_bucket, primary_drain
    empty = spark.createDataFrame([], "b timestamp, m double, hop_sequence bigint")
    assert peak_bucket(empty, "b", "m").count() == 0
    assert primary_drain(empty, "m").count() == 0

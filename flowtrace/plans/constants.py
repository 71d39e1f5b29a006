"""Fixed values of the incident dashboards.

Everything below is a value the dashboards hard-code and a recipe needs to
reproduce their output exactly: addresses, event signatures, labels,
prices, thresholds, time windows and the kill-chain edge list. They are the
recipe defaults; every one of them is a parameter of the recipes.
"""

import datetime as dt

from ..functions.scalars import hex_literal

# --- fixed values: addresses (Ethereum, Arbitrum, Tron) -----------------------
BRIDGE_ORIGIN = hex_literal("0x85d456B2DfF1fd8245387C0BfB64Dfb700e98Ef3")
ATTACKER_WALLET = hex_literal("0x8B1b6c9A6DB1304000412dd21Ae6A70a82d60D3b")
RSETH_ERC20 = hex_literal("0xa1290d69c65a6fe4df752f95823fae25cb99e5a7")
ARBITRUM_SECURITY_COUNCIL = hex_literal("0x423552c0F05baCCac5Bfa91C6dCF1dc53a0A1641")
ARBITRUM_EMERGENCY_EXECUTOR = hex_literal("0x4a4962275DF8C60a80d3a25faEc5AA7De116A746")
# The dashboard writes this literal with 41 hex digits; it is kept as written
# and read as a number, i.e. left-padded to 21 whole bytes (0x04 1a 61 ...).
# Pass ``contract=`` to the recipe to use a different byte string.
TRON_USDT_CONTRACT = hex_literal("0x41a614f803b6fd780986a42c78ec9c7f77e6ded13")
ERC20_TRANSFER_TOPIC = hex_literal(
    "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef")

# --- fixed values: prices and thresholds --------------------------------------
RSETH_PRICE_HOP_LOG = 2506.0
RSETH_PRICE_BRIDGE_DRAIN = 2506.5
ETH_PRICE = 2506.0
TRX_PRICE = 0.12
HOP_MIN_RSETH = 100
SEVERITY_BOUNDS = (50000, 10000, 1000)
COUNCIL_MIN_ETH = 10
ROUTE_MIN_ETH = 1000
SWAP_MIN_USD = 500000
USDT_MIN_TRANSFER = 1000000
TRX_MIN_UNITS = 1000000
EXPLOIT_TOTAL_USD_M = 292.0

# --- fixed values: labels ------------------------------------------------------
SEVERITY_LABELS = (
    "🔴 Primary Drain (>50k rsETH)",
    "🟠 Major Transfer (10k–50k rsETH)",
    "🟡 Intermediate Hop (1k–10k rsETH)",
    "⚪ Small Transfer (<1k rsETH)",
)
ROLE_LABELS = (
    "Bridge → Attacker (EXPLOIT)",
    "Attacker → Downstream",
    "Other",
)
DIRECTION_LABELS = (
    "Incoming → Council",
    "Outgoing ← Council",
    "Related",
)
ROUTE_LABEL = "Attacker Route"
SWAP_ROUTE_LABEL = "ThorChain ETH→BTC"
PERIOD_LABELS = ("🔴 HACK DAY", "⬇️ Post-Hack", "✅ Pre-Hack")

# --- fixed values: time windows -------------------------------------------------
HOP_LOG_DATES = (dt.date(2026, 4, 18), dt.date(2026, 4, 19))
BRIDGE_DRAIN_WINDOW = (dt.datetime(2026, 4, 18, 17, 0, 0), dt.datetime(2026, 4, 19, 6, 0, 0))
CONTAGION_WINDOW = (dt.datetime(2026, 4, 16), dt.datetime(2026, 4, 22))
TVL_WINDOW = (dt.datetime(2026, 4, 10), dt.datetime(2026, 4, 23))
HACK_DAY = dt.date(2026, 4, 18)
COUNCIL_DATES = (dt.date(2026, 4, 18), dt.date(2026, 4, 22))
ROUTE_DATES = (dt.date(2026, 4, 18), dt.date(2026, 4, 20))
LAUNDERING_WINDOW = (dt.datetime(2026, 4, 18), dt.datetime(2026, 5, 1))
LAUNDERING_DATES = (dt.date(2026, 4, 18), dt.date(2026, 5, 1))

# --- fixed values: kill-chain edges (step, source, target, USD millions, note) -
KILL_CHAIN_EDGES = [
    (1, "Kelp DAO Bridge Contract", "Attacker Wallet (Lazarus)", "292.0",
     "rsETH drain via price oracle exploit"),
    (2, "Attacker Wallet (Lazarus)", "Aave v3 Ethereum (Collateral)", "292.0",
     "116,500 rsETH deposited as collateral"),
    (3, "Aave v3 Ethereum (Collateral)", "Attacker Wallet (ETH/WETH)", "190.0",
     "~75,800 ETH/WETH borrowed at 65% LTV"),
    (4, "Attacker Wallet (ETH/WETH)", "Arbitrum Bridge", "77.1",
     "30,766 ETH bridged to Arbitrum"),
    (5, "Attacker Wallet (ETH/WETH)", "ThorChain Router (Ethereum)", "112.9",
     "Remaining ETH routed through ThorChain"),
    (6, "Arbitrum Bridge", "Security Council Freeze", "77.1",
     "30,766 ETH frozen by 9-of-12 multisig"),
    (7, "ThorChain Router (Ethereum)", "Bitcoin Wallets (BTC)", "112.9",
     "$112.9M worth of ETH swapped to BTC"),
    (8, "Bitcoin Wallets (BTC)", "Tron USDT (TR7NH...)", "62.0",
     "$62M USDT bridge-in via P2P exchanges"),
    (9, "Bitcoin Wallets (BTC)", "Cold BTC Storage (Lazarus)", "50.9",
     "$50.9M BTC held in Lazarus cold wallets"),
]
RECOVERED_NODES = ("Security Council Freeze",)

# --- fixed values: dashboard column labels (snake_case column -> label) ---------
HOP_LOG_LABELS = {
    "hop_sequence": "Hop #", "block_time": "Block Time (UTC)", "block_number": "Block",
    "tx_hash": "Tx Hash", "from_address": "From Address", "to_address": "To Address",
    "rseth_amount": "rsETH Amount", "usd_value_m": "USD Value (M)",
    "cumulative_rseth_drained": "Cumul. rsETH Drained", "classification": "Classification",
}
CONTAGION_LABELS = {
    "hour_bucket": "Hour (UTC)", "rseth_supplied": "rsETH Supplied to Aave",
    "rseth_supply_usd_m": "rsETH Supply USD (M)", "eth_weth_borrowed": "ETH/WETH Borrowed",
    "eth_borrow_usd_m": "ETH Borrow USD (M)", "cumul_eth_borrowed": "Cumul. ETH Borrowed",
}
TVL_LABELS = {
    "day_bucket": "Date", "net_supply_change_b": "Net Supply Change (B USD)",
    "net_borrow_change_b": "Net Borrow Change (B USD)",
    "cumulative_net_supply_b": "Cumulative Aave Supply TVL (B USD)",
    "period_flag": "Period Flag",
}
INTERVENTION_LABELS = {
    "hour_bucket": "Hour (UTC)", "flow_type": "Flow Type", "tx_count": "Tx Count",
    "eth_volume": "ETH Volume", "usd_volume_m": "USD Volume (M)",
    "cumulative_eth": "Cumulative ETH",
}
LAUNDERING_LABELS = {
    "day_bucket": "Date", "thorchain_swap_count": "ThorChain Swap Count",
    "eth_to_btc": "ETH → BTC (ThorChain)", "btc_received": "BTC Received",
    "thorchain_volume_m": "ThorChain Volume (M USD)",
    "tron_usdt_transfers": "Tron USDT Transfers", "tron_usdt_volume_m": "Tron USDT Volume (M)",
    "total_laundered_m": "Total Laundered (M USD)",
}
LAUNDERING_V2_LABELS = {
    "day_bucket": "Date", "thorchain_swaps": "ThorChain ETH→BTC Swaps",
    "eth_swapped": "ETH Swapped", "btc_received": "BTC Received",
    "thorchain_volume_m": "ThorChain Volume (M USD)",
    "tron_large_tx_count": "Tron Large Tx Count",
    "tron_value_usd_m": "Tron Value (M USD, est.)",
    "total_laundering_flow_m": "Total Laundering Flow (M USD)",
}
KILL_CHAIN_LABELS = {
    "step": "Step", "source_node": "Source", "target_node": "Destination",
    "value_usd_m": "Value (M USD)", "notes": "Description",
    "pct_of_total": "% of Total Exploit",
}
# The bridge-drain dashboard already uses snake_case names.

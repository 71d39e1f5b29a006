"""DataFrame operators."""

from .channels import (combine_channels, decode_token_transfers, large_swaps,
                       large_transfer_daily, native_value_proxy, swap_daily)
from .findings import dispersion, leverage_ratio, peak_bucket, primary_drain
from .graph import (flow_edges, fund_destinations, node_balances,
                    node_totals, number_edges, recovery)
from .membership import either_side, flag_member, flag_members
from .ordered import (Measure, ordered_measures, row_number, running_sum, running_total,
                      sequence_rows)
from .series import (align_legs, align_legs_spine, bucket_flow, bucket_legs, net_flow,
                     period_flag, signed_amount)
from .transfers import (above, classify_role, drain_progress, flow_direction, hop_log,
                        in_window, large_moves, merge_tagged, merge_without_duplicates,
                        normalize_transfers, not_in, quarantined, severity_tier, 
                        watchlist_roles, watchlist_transfers)

__all__ = [
    "combine_channels", "decode_token_transfers", "large_swaps", "large_transfer_daily",
    "native_value_proxy", "swap_daily", "dispersion", "leverage_ratio", "peak_bucket",
    "primary_drain", "flow_edges", "fund_destinations",
    "node_balances", "node_totals", "number_edges", "recovery", "either_side", "flag_member",
    "flag_members", "Measure", "ordered_measures", "row_number", "running_sum",
    "running_total", "sequence_rows", "align_legs", "align_legs_spine", "bucket_flow", "bucket_legs",
    "net_flow", "period_flag", "signed_amount", "above", "classify_role", "drain_progress",
    "flow_direction", "hop_log", "in_window", "large_moves", "merge_without_duplicates",
    "normalize_transfers", "not_in", "quarantined", "severity_tier", "watchlist_roles",
    "watchlist_transfers",
]

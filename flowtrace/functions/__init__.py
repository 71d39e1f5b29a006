from .scalars import (bytes_to_bigint, bytes_to_decimal, hex_0x, hex_literal, hex_upper, int_to_bytes,
                      lit_number, scale_units, shorten, text_to_bytes,
                      truncate_time)
from .predicates import (any_equal, between_closed, between_half_open, like,
                         partition_bound, window_predicate)

__all__ = [
    "bytes_to_bigint", "bytes_to_decimal", "hex_0x", "hex_literal", "hex_upper", "int_to_bytes", "lit_number",
    "scale_units", "shorten", "text_to_bytes", "truncate_time",
    "any_equal", "between_closed", "between_half_open", "like", "partition_bound",
    "window_predicate",
]

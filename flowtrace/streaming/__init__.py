"""Structured Streaming forms of the bucket operators."""

from .monitor import (compact_partials, merged_buckets, start_bucket_partials, start_to_table,
                      stream_bucket_flow, stream_watchlist_roles)

__all__ = ["compact_partials", "merged_buckets", "start_bucket_partials", "start_to_table",
           "stream_bucket_flow", "stream_watchlist_roles"]

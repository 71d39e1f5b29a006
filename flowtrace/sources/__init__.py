"""Chain-table schemas, readers and writers, and the driver-table bindings."""

from .tables import (PARTITION_KEYS, SCHEMAS, read_chain_table, write_chain_table,
                     write_result)

__all__ = ["PARTITION_KEYS", "SCHEMAS", "read_chain_table", "write_chain_table",
           "write_result"]

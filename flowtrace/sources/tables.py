"""Reading chain tables and writing result tables.

Chain tables are large, append-only and time-partitioned
(``block_date``/``block_month``). They are read as Parquet (or a catalog
table) with an explicit schema when one is known, so the scan never infers
types from data, and written partitioned by their date key so every
time-window predicate becomes a ``PartitionFilters`` entry in the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column types of the chain tables the recipes read (FIXTURES.md §1).
BIN = T.BinaryType()
TS = T.TimestampType()
RAW = T.DecimalType(38, 0)

SCHEMAS: dict[str, T.StructType] = {
    "rseth_evt_transfer": T.StructType([
        T.StructField("evt_tx_hash", BIN), T.StructField("evt_index", T.LongType()),
        T.StructField("evt_block_time", TS),
        T.StructField("evt_block_number", T.LongType()), T.StructField("from", BIN),
        T.StructField("to", BIN), T.StructField("value", RAW),
        T.StructField("evt_block_date", T.DateType())]),
    "erc20_evt_transfer": T.StructType([
        T.StructField("block_time", TS), T.StructField("tx_hash", BIN),
        T.StructField("from", BIN), T.StructField("to", BIN), T.StructField("value", RAW),
        T.StructField("contract_address", BIN), T.StructField("block_date", T.DateType())]),
    "lending_supply": T.StructType([
        T.StructField("block_time", TS), T.StructField("block_month", T.DateType()),
        T.StructField("blockchain", T.StringType()), T.StructField("project", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("amount_usd", T.DoubleType())]),
    "arbitrum_transactions": T.StructType([
        T.StructField("block_time", TS), T.StructField("block_number", T.LongType()),
        T.StructField("hash", BIN), T.StructField("from", BIN), T.StructField("to", BIN),
        T.StructField("value", RAW), T.StructField("block_date", T.DateType()),
        T.StructField("success", T.BooleanType())]),
    "thorchain_swaps": T.StructType([
        T.StructField("block_timestamp", TS), T.StructField("tx_id", T.StringType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("from_asset", T.StringType()), T.StructField("to_asset", T.StringType()),
        T.StructField("from_amount", T.DoubleType()), T.StructField("to_amount", T.DoubleType()),
        T.StructField("from_amount_usd", T.DoubleType()),
        T.StructField("block_date", T.DateType())]),
    "tron_logs": T.StructType([
        T.StructField("block_time", TS), T.StructField("block_date", T.DateType()),
        T.StructField("tx_hash", BIN), T.StructField("tx_from", BIN),
        T.StructField("tx_to", BIN), T.StructField("data", BIN),
        T.StructField("contract_address", BIN), T.StructField("topic0", BIN)]),
    "tron_transactions": T.StructType([
        T.StructField("block_date", T.DateType()), T.StructField("value", RAW),
        T.StructField("success", T.BooleanType())]),
}
SCHEMAS["lending_borrow"] = SCHEMAS["lending_supply"]

PARTITION_KEYS = {
    "rseth_evt_transfer": ("evt_block_date",),
    "erc20_evt_transfer": ("block_date",),
    "thorchain_swaps": ("block_date",),
    "lending_supply": ("block_month",),
    "lending_borrow": ("block_month",),
    "arbitrum_transactions": ("block_date",),
    "tron_logs": ("block_date",),
    "tron_transactions": ("block_date",),
}


#: Order of rows inside a date: the columns whose filters the recipes push into
#: the scan, so that a row group covers a narrow range of them.
CLUSTER_KEYS = {
    "rseth_evt_transfer": ("value",),
    "erc20_evt_transfer": ("contract_address", "from"),
    "lending_supply": ("blockchain", "project", "symbol"),
    "lending_borrow": ("blockchain", "project", "symbol"),
    "arbitrum_transactions": ("from", "value"),
    "thorchain_swaps": ("from_amount_usd",),
    "tron_logs": ("contract_address", "topic0"),
    "tron_transactions": ("value",),
}

#: Columns looked up by equality that the order doesn't serve: one Parquet
#: Bloom filter per row group each.
BLOOM_COLUMNS = {
    "rseth_evt_transfer": ("from", "to", "evt_tx_hash"),
    "erc20_evt_transfer": ("from", "to", "tx_hash"),
    "arbitrum_transactions": ("from", "to", "hash"),
    "tron_logs": ("topic0", "tx_hash"),
}


def read_chain_table(spark: SparkSession, name: str, path: str | None = None,
                     fmt: str = "parquet") -> DataFrame:
    """SRC-1…8: a chain table from a path (with its known schema) or, when
    ``path`` is None, from the catalog under ``name``."""
    if path is None:
        return spark.table(name)
    reader = spark.read.format(fmt)
    schema = SCHEMAS.get(name)
    if schema is not None and fmt in ("parquet", "orc", "json", "csv"):
        reader = reader.schema(schema)
    return reader.load(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: Sequence[str] = ()) -> None:
    """SNK-1: write a result table (Parquet by default, CSV for dashboards)."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def write_chain_table(df: DataFrame, path: str, name: str, mode: str = "overwrite",
                      max_records_per_file: int = 5_000_000,
                      row_group_bytes: int = 128 * 1024 * 1024,
                      cluster_by: Sequence[str] | None = None,
                      bloom: Sequence[str] | None = None) -> None:
    """Store a chain table partitioned by its date key so time windows prune
    whole folders, and clustered inside a date so filters prune row groups.

    The ``rebalance`` hint shuffles rows by the partition key so each date
    folder gets few, large files; AQE then splits a hot date (say the
    incident day holding a third of all rows) into several tasks and merges
    small ones, so no single task writes a hot date alone. Each task orders
    its rows by date and ``cluster_by`` (default: ``CLUSTER_KEYS`` of the
    table; rows without a value first), so a row group's minimum and maximum
    decide an address, topic or amount filter; ``bloom`` columns (default:
    ``BLOOM_COLUMNS``) carry a Parquet Bloom filter per row group, sized by
    the values it holds. Columns that ``df`` lacks are left out.
    ``max_records_per_file`` caps the file size within a task.
    """
    present = set(df.columns)
    keys = PARTITION_KEYS.get(name, ())
    order = [c for c in (CLUSTER_KEYS.get(name, ()) if cluster_by is None else cluster_by)
             if c in present]
    looked_up = [c for c in (BLOOM_COLUMNS.get(name, ()) if bloom is None else bloom)
                 if c in present]
    if keys:
        df = df.hint("rebalance", *keys)
    if order:
        df = df.sortWithinPartitions(*keys, *order)
    writer = df.write.mode(mode).format("parquet") \
        .option("maxRecordsPerFile", str(max_records_per_file)) \
        .option("parquet.block.size", str(row_group_bytes))
    if looked_up:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(path)

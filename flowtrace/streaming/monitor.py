"""Operators on append-only streams: the bucket series (OP-10) and the
watchlist roles (OP-4/5).

Chain tables only grow, and the dashboards re-run their hourly/daily
aggregates as blocks arrive. There are two streaming forms:

* :func:`stream_bucket_flow`, a tumbling event-time window with a watermark:
  a bucket is emitted once, when the watermark passes its end. State stays
  bounded, and rows later than ``lateness`` are **lost**, so the caller has to
  choose it.
* :func:`start_bucket_partials`, which loses nothing: every micro-batch
  appends its partial aggregates, one row per bucket it touched, and
  :func:`merged_buckets` merges them. A late row reopens its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.double_sum import sum_of
from ..operators.series import bucket_flow

UNITS = {"hour": "1 hour", "day": "1 day"}


def stream_bucket_flow(events: DataFrame, time_col: str, unit: str,
                       measures: dict[str, Column], keys: Sequence[str] = (), *,
                       lateness: str, bucket: str = "bucket") -> DataFrame:
    """Streaming form of :func:`flowtrace.operators.series.bucket_flow`.

    Rows that arrive more than ``lateness`` behind the newest event time may
    be dropped; where every row has to count, use
    :func:`start_bucket_partials`.

    ``events`` is a streaming DataFrame (``readStream`` over a chain table);
    the result has one row per closed bucket (and key) with the same
    measures as the batch operator.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    ntz = isinstance(events.schema[time_col].dataType, TimestampNTZType)
    if ntz:
        # Watermarks need a session-zone timestamp; chain times are UTC
        # wall-clock values, so the cast (session zone UTC) keeps them.
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    grouped = (events.withWatermark(time_col, lateness)
               .groupBy(F.window(time_col, UNITS[unit]).alias("_w"), *keys)
               .agg(*[expr.alias(name) for name, expr in measures.items()]))
    start = F.col("_w.start")
    if ntz:
        start = start.cast("timestamp_ntz")
    return grouped.select(start.alias(bucket), *keys, *measures.keys())


#: How partial aggregates merge.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def start_bucket_partials(events: DataFrame, time_col: str, unit: str,
                          measures: dict[str, tuple[str, str | None]], path: str, checkpoint: str,
                          keys: Sequence[str] = (), bucket: str = "bucket", trigger: dict | None = None):
    """Start a query that stores each micro-batch's partial aggregates.

    ``measures`` is ``{name: ("count", None) | ("sum" | "min" | "max",
    column)}``. A micro-batch writes one row per bucket and key it holds into
    a folder of its own below ``path``; a repeated batch replaces its folder,
    so every row counts once. ``path`` and ``checkpoint`` are on shared
    storage. A folder per batch piles up: :func:`compact_partials` merges them
    while the query is stopped."""
    aggs = {name: F.count(F.lit(1)) if func == "count" else
            sum_of(events, column) if func == "sum" else MERGE[func](column)
            for name, (func, column) in measures.items()}

    def store(batch: DataFrame, number: int) -> None:
        bucket_flow(batch, time_col, unit, aggs, keys=keys, bucket=bucket) \
            .write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def merged_buckets(spark: SparkSession, path: str, measures: dict[str, tuple[str, str | None]],
                   keys: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """The bucket series of all micro-batches so far: partial aggregates of
    one bucket merged, whenever its rows came."""
    partials = spark.read.parquet(path)
    return partials.groupBy(bucket, *keys).agg(*[
        (sum_of(partials, name) if func in ("count", "sum") else MERGE[func](name)).alias(name)
        for name, (func, _) in measures.items()])


def compact_partials(spark: SparkSession, path: str, target: str,
                     measures: dict[str, tuple[str, str | None]], keys: Sequence[str] = (),
                     bucket: str = "bucket") -> None:
    """Writes the merged partials of ``path`` as one batch folder of
    ``target``; later batches can be added beside it."""
    merged_buckets(spark, path, measures, keys, bucket).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def start_to_table(result: DataFrame, table: str, checkpoint: str,
                   trigger_seconds: int | None = None):
    """Append closed buckets to a table. ``checkpoint`` must be a folder on
    shared storage (the streaming state and offsets live there)."""
    writer = (result.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.toTable(table)


def stream_watchlist_roles(transfers_stream: DataFrame, origin, suspect, labels, *,
                           sender: str = "sender", receiver: str = "receiver",
                           out: str = "transfer_type") -> DataFrame:
    """Transfers touching the watchlists, labelled by role, as they arrive.

    Stateless, so no watermark is needed: each micro-batch is filtered and
    labelled on its own. Literal addresses are an ``IN`` predicate; a
    watchlist table is a static DataFrame and becomes a stream-static join
    (re-read per micro-batch, so list updates reach the next batch).
    """
    from ..operators.transfers import watchlist_roles
    return watchlist_roles(transfers_stream, origin, suspect, labels, sender=sender,
                           receiver=receiver, out=out)

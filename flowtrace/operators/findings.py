"""Headline findings over the series and hop log (RD-3 … RD-6).

Each is one distributed aggregate producing a single row: partial
aggregation in every task, one tiny final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def peak_bucket(series: DataFrame, bucket: str, measure: str) -> DataFrame:
    """RD-3: the bucket with the largest measure (earliest bucket on ties);
    no row for an empty series."""
    best = F.min_by(F.struct(F.col(bucket).alias("b"), F.col(measure).alias("m")),
                    F.struct((-F.col(measure)).alias("neg"), F.col(bucket).alias("b")))
    return (series.where(F.col(measure).isNotNull()).agg(best.alias("_best"))
            .where(F.col("_best").isNotNull())
            .select(F.col("_best.b").alias(f"peak_{bucket}"),
                    F.col("_best.m").alias(f"peak_{measure}")))


def leverage_ratio(collateral: DataFrame, borrowed: DataFrame, collateral_col: str,
                   borrowed_col: str, digits: int = 4) -> DataFrame:
    """RD-4: total borrowed / total collateral (``65% LTV``). Both totals come
    from distributed sums; division by zero yields NULL."""
    ctype = collateral.schema[collateral_col].dataType
    btype = borrowed.schema[borrowed_col].dataType
    both = (collateral.select(F.col(collateral_col).alias("_c"), F.lit(None).cast(btype).alias("_b"))
            .unionByName(borrowed.select(F.lit(None).cast(ctype).alias("_c"),
                                         F.col(borrowed_col).alias("_b"))))
    row = both.agg(F.sum("_c").alias("total_collateral"), F.sum("_b").alias("total_borrowed"))
    ratio = F.try_divide(F.col("total_borrowed").cast("double"),
                         F.col("total_collateral").cast("double"))
    return row.withColumn("ltv", F.round(ratio, digits))


def primary_drain(hops: DataFrame, amount: str, order_by: str = "hop_sequence") -> DataFrame:
    """RD-5: the single largest hop (earliest on ties), all its columns; no
    row when there are no hops."""
    cols = hops.columns
    best = F.min_by(F.struct(*[F.col(c) for c in cols]),
                    F.struct((-F.col(amount)).alias("neg"), F.col(order_by).alias("o")))
    return (hops.where(F.col(amount).isNotNull()).agg(best.alias("_best"))
            .where(F.col("_best").isNotNull())
            .select(*[F.col(f"_best.{c}").alias(c) for c in cols]))


def largest_with_place(rows: DataFrame, amount: str, order_by: Sequence[str], place: str,
                       total: str) -> DataFrame:
    """The row with the greatest amount (first in ``order_by`` of equals) with
    its place in that order and the running total up to it; no row without
    amounts. Nothing is sorted or numbered: one aggregate finds the row's
    keys, a second counts and sums the rows up to them. ``order_by`` must be
    a total order; NULL keys come last."""
    known = rows.where(F.col(amount).isNotNull())
    key = F.struct(*(x for c in order_by for x in (F.col(c).isNull(), F.col(c))))
    first = F.struct((-F.col(amount)).alias("neg"), key.alias("key"))
    best = known.agg(F.min(first).getField("key")).scalar()
    found = rows.where(key <= best).agg(
        F.count(F.lit(1)).alias(place), F.sum(amount).alias(total),
        F.min_by(F.struct(*rows.columns), F.when(F.col(amount).isNotNull(), first)).alias("_row"))
    return found.where(F.col("_row").isNotNull()).select("_row.*", place, total)


def dispersion(hops: DataFrame, time_col: str = "block_time") -> DataFrame:
    """RD-6: hop count, first and last hop time and the span in seconds."""
    agg = hops.agg(F.count(F.lit(1)).alias("hop_count"),
                   F.min(time_col).alias("first_hop_time"),
                   F.max(time_col).alias("last_hop_time"))
    span = (F.unix_micros(F.col("last_hop_time").cast("timestamp"))
            - F.unix_micros(F.col("first_hop_time").cast("timestamp"))) / F.lit(1_000_000)
    return agg.withColumn("dispersion_seconds", span.cast("double"))

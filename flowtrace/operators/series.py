"""Time-bucket series (OP-10 … OP-14).

Bucketing is a partial/final hash aggregate: each task pre-aggregates its
rows per bucket before the shuffle, so a hot hour costs one partial row per
task, not one shuffled row per event. Running totals over the buckets are
:func:`flowtrace.operators.ordered.running_total`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.double_sum import stable_sum, sum_of
from ..functions.scalars import truncate_time
from .ordered import running_total  # noqa: F401  (part of this module's interface)


def bucket_column(df: DataFrame, time_col: str, unit: str, out: str) -> Column:
    """``date_trunc(unit, time_col)`` with the source timestamp flavour
    preserved; ``unit='date'`` casts to DATE."""
    return truncate_time(time_col, unit, like=df.schema[time_col].dataType).alias(out)


def bucket_flow(df: DataFrame, time_col: str, unit: str, measures: dict[str, Column],
                keys: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """OP-10: per-bucket (and optional key) aggregates, e.g.
    ``{"tx_count": F.count(F.lit(1)), "volume": F.sum("amount")}``."""
    return (df.select(bucket_column(df, time_col, unit, bucket), *keys,
                      *[c for c in df.columns if c not in keys and c != bucket])
              .groupBy(bucket, *keys)
              .agg(*[expr.alias(name) for name, expr in measures.items()]))


def signed_amount(type_col: str, amount: str, plus: str, minus: str) -> Column:
    """AGG-5 term: +amount for ``plus`` rows, -amount for ``minus`` rows, 0
    for any other (or NULL) type."""
    t = F.col(type_col)
    return (F.when(t == F.lit(plus), F.col(amount))
             .when(t == F.lit(minus), -F.col(amount))
             .otherwise(F.lit(0)))


def net_flow(df: DataFrame, time_col: str, unit: str, type_col: str, amount: str,
             plus: str, minus: str, out: str, bucket: str = "bucket") -> DataFrame:
    """OP-11: signed inflow minus outflow per bucket."""
    signed = signed_amount(type_col, amount, plus, minus)
    return bucket_flow(df, time_col, unit, {out: stable_sum(signed, df.schema[amount].dataType)}, bucket=bucket)


def align_legs(legs: Sequence[DataFrame], key: str, fill=0) -> DataFrame:
    """OP-12: merge N bucket series on their bucket key, zero-filling gaps.

    Each leg must be unique on ``key`` (a GROUP BY output). The result equals
    the dashboards' spine form (UNION of keys, then one LEFT JOIN per leg)
    with one full outer join per extra leg instead of a distinct + N joins:
    buckets present in any leg appear once, buckets absent from every leg
    stay absent (no calendar densification). A NULL bucket, which the spine
    can hold but never matches, appears once with every measure filled.
    """
    if not legs:
        raise ValueError("align_legs needs at least one leg")
    measure_cols = []
    for leg in legs:
        measure_cols.extend(c for c in leg.columns if c != key)
    if len(set(measure_cols)) != len(measure_cols):
        raise ValueError("measure column names must be unique across legs")
    out = legs[0]
    for leg in legs[1:]:
        left, right = out.alias("__ft_l"), leg.alias("__ft_r")
        merged = left.join(right, F.col(f"__ft_l.{key}").eqNullSafe(F.col(f"__ft_r.{key}")),
                           "full_outer")
        out = merged.select(
            F.coalesce(F.col(f"__ft_l.{key}"), F.col(f"__ft_r.{key}")).alias(key),
            *[F.col(f"__ft_l.{c}") for c in out.columns if c != key],
            *[F.col(f"__ft_r.{c}") for c in leg.columns if c != key])
    k = F.col(key)
    return out.select(k, *[
        F.when(k.isNull(), F.lit(fill)).otherwise(F.coalesce(F.col(c), F.lit(fill))).alias(c)
        for c in measure_cols])


def align_legs_spine(legs: Sequence[DataFrame], key: str, fill=0) -> DataFrame:
    """The dashboards' literal form (SET-1 + JOI-1): distinct union of keys,
    then a left join per leg. Kept for equivalence tests."""
    spine = legs[0].select(key)
    for leg in legs[1:]:
        spine = spine.union(leg.select(key))
    out = spine.distinct()
    for leg in legs:
        out = out.join(leg, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(fill)).alias(c)
                             for leg in legs for c in leg.columns if c != key])


def bucket_legs(legs: Sequence[tuple[DataFrame, str, dict[str, tuple[str, Column | None]]]],
                unit: str, bucket: str = "bucket", fill=0) -> DataFrame:
    """OP-10 + OP-12 in one aggregate: bucket several legs and align them.

    ``legs`` is ``[(frame, time column, {measure: ("sum", value) |
    ("count", None)}), …]``. Each leg's rows carry only their own measure
    columns; the legs are stacked and one ``groupBy(bucket)`` computes every
    measure (partial aggregation in each task, one shuffle), where
    per-leg aggregates plus an outer join would shuffle once per leg and
    again for the join. A bucket with no rows in a leg gets ``fill`` for
    that leg's measures, buckets with no rows at all do not appear, and a
    NULL bucket appears once with every measure filled: the same rows as
    :func:`align_legs` over per-leg :func:`bucket_flow` results.
    """
    parts, aggs = [], []
    for i, (df, time_col, measures) in enumerate(legs):
        cols, summed = [bucket_column(df, time_col, unit, bucket)], []
        for name, (func, value) in measures.items():
            if func == "count":
                cols.append(F.lit(1).alias(name))
                aggs.append(F.count(name).alias(name))
            elif func == "sum":
                cols.append((F.col(value) if isinstance(value, str) else value).alias(name))
                summed.append(name)
            else:
                raise ValueError(f"unknown aggregate {func!r}")
        parts.append(df.select(*cols))
        aggs += [sum_of(parts[-1], name).alias(name) for name in summed]
    names = [a for part in parts for a in part.columns if a != bucket]
    if len(set(names)) != len(names):
        raise ValueError("measure names must be unique across legs")
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    k = F.col(bucket)
    out = stacked.groupBy(bucket).agg(*aggs)
    return out.select(k, *[
        F.when(k.isNull(), F.lit(fill)).otherwise(F.coalesce(F.col(c), F.lit(fill))).alias(c)
        for c in names])


def period_flag(df: DataFrame, day_col: str, pivot, labels: Sequence[str],
                out: str = "period_flag") -> DataFrame:
    """OP-14: label 0 on the pivot day, label 1 after it, label 2 before it
    (and for NULL days, the SQL ELSE branch)."""
    d = F.col(day_col)
    p = F.lit(pivot)
    return df.withColumn(out, F.when(d == p, F.lit(labels[0]))
                                .when(d > p, F.lit(labels[1]))
                                .otherwise(F.lit(labels[2])))

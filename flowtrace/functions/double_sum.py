"""Sums of doubles that don't depend on the order of addition.

A double below 2^113 is cut, without rounding, into four integers: how many
2^50, ones, 2^-50 and 2^-100 it holds. Their sums are exact decimals, which
merge in any order, and become one double at the end; what a single value has
below 2^-100 is left out. Larger values, NaN and infinities are added up as
plain doubles beside that.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP, LARGEST = float(2 ** 50), float(2 ** 113)


def double_sum(c) -> Column:
    """Aggregate: SUM of a double column, the same bits for any layout."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    fits = F.abs(x) < F.lit(LARGEST)
    value, sums = F.when(fits, x) * F.lit(1 / STEP), []
    for k in range(4):
        whole = value.cast("bigint")
        sums.append(F.sum(whole.cast("decimal(19,0)" if k == 0 else "decimal(16,0)")))
        value = (value - whole.cast("double")) * F.lit(STEP)
    high, ones, low, lowest = sums
    narrow = F.abs(high) < F.lit(Decimal(10 ** 20))
    total = F.when(narrow, ((high * F.lit(2 ** 50)).cast("decimal(38,0)") + ones).cast("double")).otherwise(
        high.cast("double") * F.lit(STEP) + ones.cast("double"))
    total = total + (low.cast("double") * F.lit(1 / STEP) + lowest.cast("double") * F.lit(1 / STEP ** 2))
    rest = F.sum(F.when(~fits, x))
    return F.when(rest.isNull(), total).otherwise(rest + F.coalesce(total, F.lit(0.0)))


def stable_sum(c, kind: T.DataType) -> Column:
    """SUM whose result doesn't depend on the order: :func:`double_sum` of
    floating-point columns, the plain sum of others."""
    return double_sum(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.sum(c)


def sum_of(df: DataFrame, name: str) -> Column:
    return stable_sum(name, df.schema[name].dataType)

"""Row predicates: time windows, partition bounds, patterns, watchlists."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import _col


def _lit_time(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value)


def between_closed(c, start, end) -> Column:
    """``start <= c <= end`` (date windows in the dashboards)."""
    c = _col(c)
    return (c >= _lit_time(start)) & (c <= _lit_time(end))


def between_half_open(c, start, end) -> Column:
    """``start <= c < end`` (timestamp windows)."""
    c = _col(c)
    return (c >= _lit_time(start)) & (c < _lit_time(end))


def window_predicate(c, start=None, end=None, closed: bool = False) -> Column:
    """Optional-bound window; ``None`` bounds are open."""
    c = _col(c)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= _lit_time(start))
    if end is not None:
        cond = cond & ((c <= _lit_time(end)) if closed else (c < _lit_time(end)))
    return cond


def month_start(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        value = value.date()
    return value.replace(day=1)


#: Partition keys that follow a time column: how a time becomes a key.
KEY_OF_TIME = {
    "date": lambda t: t.date() if isinstance(t, _dt.datetime) else t,
    "month": month_start,
}


def partition_bound(part_col: str, start=None, unit: str = "month", end=None,
                    closed: bool = False) -> Column:
    """The interval of partition keys implied by a time window.

    Spark cannot derive a ``block_month``/``block_date`` predicate from a
    ``block_time`` predicate on plain Parquet; this states the redundant one
    at both ends, so the scan opens the window's partitions only. A half-open
    window that ends on the first instant of a partition leaves it out;
    ``closed`` windows include their end.
    """
    if unit not in KEY_OF_TIME:
        raise ValueError(f"unknown partition unit {unit!r}")
    key = KEY_OF_TIME[unit]
    out = F.lit(True) if start is None else F.col(part_col) >= F.lit(key(start))
    if end is None:
        return out
    last = key(end)
    first_instant = last if not isinstance(end, _dt.datetime) else _dt.datetime.combine(last, _dt.time(), end.tzinfo)
    if not closed and end == first_instant:
        return out & (F.col(part_col) < F.lit(last))
    return out & (F.col(part_col) <= F.lit(last))


def like(c, pattern: str) -> Column:
    """Case-sensitive SQL LIKE."""
    return _col(c).like(pattern)


def any_equal(c, values) -> Column:
    """Membership in a small literal list (pushed to the Parquet scan)."""
    values = list(values)
    if len(values) == 1:
        return _col(c) == F.lit(values[0])
    return _col(c).isin(values)

"""Order-dependent measures: sequence numbers and running totals.

SQL writes these as ``ROW_NUMBER() OVER (ORDER BY t)`` and
``SUM(x) OVER (ORDER BY t)``. Without ``PARTITION BY`` Spark plans such a
window as one task over all rows. ``ordered_measures`` gives the same result
with one plan for every input size, built lazily:

1. rows are grouped by a chain of ever finer keys that follow the order: the
   day of the first key, the first key, a coarse digit of each later key (two
   bytes of a hash, an index over 4096), the key itself. So one block is cut by
   its hashes and one transaction by its log indexes, however many rows share
   an instant;
2. each group's totals (partial aggregation, one row per group) become
   offsets step by step: groups within the next shorter chain, and so on up
   to days. Only the last step, one row per day (or per distinct first key
   where that is not a time), is accumulated in one task;
3. a local window numbers and accumulates each group after the one exchange
   that rows go through, and the offsets join back on the group keys, by which
   the rows are partitioned already. With one order key and RANGE frames (all
   peers share one total) groups are the peers and no row is sorted or windowed:
   an instant that holds a third of all rows is pre-aggregated for its total,
   and only the join meets it, where AQE splits it.

The cuts are functions of a row's own keys, not sampled: nothing depends on the
number of partitions, on a size estimate or on a checkpoint, and a second
evaluation after a lost executor gives the same groups. Doubles are accumulated
as decimals and converted at the end, so results don't depend on the order of
addition either. Rows that agree in all of several order keys stay in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Doubles are summed with this type (nine places, 29 digits before them).
EXACT_SUM = "decimal(38,9)"


def _sort_keys(cols: Sequence[str]) -> list[Column]:
    # NULLS LAST, as in the SQL engines the dashboards target.
    return [F.col(c).asc_nulls_last() for c in cols]


class Measure:
    """One order-dependent output column.

    kind: ``"row_number"`` (1-based position) or ``"sum"`` (running total).
    frame: ``"range"`` (SQL default: peers with equal order keys share one
    total) or ``"rows"`` (strictly row by row).
    """

    def __init__(self, out: str, kind: str, value: Column | str | None = None,
                 frame: str = "range"):
        if kind not in ("row_number", "sum"):
            raise ValueError(f"unknown measure kind {kind!r}")
        if kind == "sum" and value is None:
            raise ValueError("a running sum needs a value")
        if frame not in ("range", "rows"):
            raise ValueError(f"unknown frame {frame!r}")
        self.out = out
        self.kind = kind
        self.value = F.col(value) if isinstance(value, str) else value
        self.frame = frame


def row_number(out: str) -> Measure:
    return Measure(out, "row_number")


def running_sum(out: str, value, frame: str = "range") -> Measure:
    return Measure(out, "sum", value, frame)


def _day(c: Column, kind: T.DataType) -> Column | None:
    """The coarse form of a first key (None: it is not a time)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.trunc(c, "year") if isinstance(kind, T.DateType) else None


def _digit(c: Column, kind: T.DataType) -> Column | None:
    """A coarse form of a later key that keeps its order (None: its type has none)."""
    if isinstance(kind, T.BinaryType):
        return F.substring(c, 1, 2)
    if kind == T.StringType():
        return F.substring(c, 1, 4)
    if isinstance(kind, T.IntegralType):
        return F.shiftright(c.cast("bigint"), 12)
    return None


def _chain(order_by: Sequence[str], types: dict[str, T.DataType],
           peers: bool) -> tuple[list[list[tuple[str, bool]]], list[str]]:
    """(steps, local): what each step adds to the group keys, as (key, is it
    the coarse form), and the keys that order rows inside the finest group."""
    coarse = [(_digit if i else _day)(F.lit(None).cast(types[c]), types[c]) is not None
              for i, c in enumerate(order_by)]
    inner = len(order_by) - (not peers)
    steps = [[(c, form)] for c, has in list(zip(order_by, coarse))[:inner]
             for form in ((True, False) if has else (False,))]
    last = order_by[-1]
    if peers:
        return steps, []
    if coarse[-1] and inner > 1:
        steps[-1].append((last, True))
    elif coarse[-1]:
        steps.append([(last, True)])
    return (steps, [last]) if steps else ([[(last, False)]], [])


def _never_null(c: Column, kind: T.DataType) -> Column:
    """The value, or any constant of its type: with a null flag beside it, a
    join key that plain equality matches."""
    if isinstance(kind, T.BinaryType):
        blank = F.lit(b"")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        blank = F.lit("1970-01-01").cast(kind)
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        blank = F.lit(0).cast(kind)
    else:
        blank = F.lit("").cast(kind)
    return F.coalesce(c, blank)


def ordered_measures(df: DataFrame, order_by: Sequence[str], measures: Sequence[Measure],
                     partition_by: Sequence[str] = ()) -> DataFrame:
    """Add sequence numbers / running totals ordered by ``order_by``.

    Results equal the plain SQL window with the default frame (or a ROWS
    frame for ``frame="rows"``). With a total order the numbers of equal rows
    don't depend on the layout.
    """
    order_by, partition_by = list(order_by), list(partition_by)
    types = {f.name: f.dataType for f in df.schema}
    peers = len(order_by) == 1 and all(m.kind == "sum" and m.frame == "range" for m in measures)
    steps, local = _chain(order_by, types, peers)

    # Two columns per key: is it null (nulls come last), and the value. Rows
    # carry the finest form of each key; coarser ones are taken from the totals.
    added, derived, parts = [], [], []
    exact = {c for step in steps for c, coarse in step if not coarse}
    for j, c in enumerate([*partition_by, *order_by]):
        null, key = f"__ft_null{j}", f"__ft_key{j}"
        names = [null, key]
        if j < len(partition_by):
            parts += names
        elif c in exact:
            derived.append((f"__ft_coarse{j}", (_digit if c != order_by[0] else _day)(F.col(key), types[c])))
        elif any(c == k for step in steps for k, _ in step):
            form = (_digit if c != order_by[0] else _day)(F.col(c), types[c])
            kind = df.select(form.alias(key)).schema[0].dataType
            added += [F.col(c).isNull().alias(null), _never_null(form, kind).alias(f"__ft_coarse{j}")]
            continue
        else:
            continue
        added += [F.col(c).isNull().alias(null), _never_null(F.col(c), types[c]).alias(key)]
    at = {c: len(partition_by) + i for i, c in enumerate(order_by)}
    groups = [[name for c, coarse in step for name in
               (f"__ft_null{at[c]}", f"__ft_{'coarse' if coarse else 'key'}{at[c]}")] for step in steps]
    sums = {i: m for i, m in enumerate(measures) if m.kind == "sum"}
    kinds = df.select(*[m.value.alias(f"v{i}") for i, m in sums.items()]).schema if sums else []
    value_types = {i: f.dataType for i, f in zip(sums, kinds)}
    for i, m in sums.items():
        double = isinstance(value_types[i], (T.DoubleType, T.FloatType))
        added.append((m.value.cast(EXACT_SUM) if double else m.value).alias(f"__ft_value{i}"))
    work = df.select("*", *added)

    coarser = [(name, c) for name, c in derived if any(name in step for step in groups)]
    finest = [c for c in _once(parts, *groups) if c not in dict(coarser)]
    inside = Window.partitionBy(*finest)
    ordered = inside.orderBy(*_sort_keys(local)) if local else inside
    rows_frame = (ordered if local else inside.orderBy(F.lit(0))).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def local_value(i, m):
        if m.kind == "row_number":
            return F.row_number().over(ordered if local else inside.orderBy(F.lit(0))).cast("bigint")
        return F.sum(f"__ft_value{i}").over(rows_frame if m.frame == "rows" else ordered)

    totals = work.groupBy(*finest).agg(*[
        (F.count(F.lit(1)) if m.kind == "row_number" else F.sum(f"__ft_value{i}")).alias(f"__ft_total{i}")
        for i, m in enumerate(measures)])
    offsets = _offsets(totals.select("*", *[c.alias(name) for name, c in coarser]),
                       parts, groups, len(measures), own=peers).drop(*dict(coarser))
    rows = work if peers else work.select("*", *[
        local_value(i, m).alias(f"__ft_local{i}") for i, m in enumerate(measures)])
    joined = rows.join(offsets, finest)
    total_types = {f.name: f.dataType for f in totals.schema}

    out = []
    for i, m in enumerate(measures):
        own = None if peers else F.col(f"__ft_local{i}")
        before = F.col(f"__ft_before{i}")
        if m.kind == "row_number":
            value = own + F.coalesce(before, F.lit(0))
        else:
            # SUM over a frame of only NULLs is NULL; otherwise add what the
            # earlier groups contributed.
            value = before if peers else F.when(own.isNull() & before.isNull(), F.lit(None)).otherwise(
                F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)))
            value = value.cast("double" if isinstance(value_types[i], (T.DoubleType, T.FloatType))
                               else total_types[f"__ft_total{i}"])
        out.append(value.alias(m.out))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def _once(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(c for names in lists for c in names))


def _offsets(totals: DataFrame, parts: list[str], groups: list[list[str]], n: int,
             own: bool = False) -> DataFrame:
    """(keys, __ft_before…): what all groups before each one add up to, with
    ``own`` the group itself included."""
    upper = _once(*groups[:-1])
    before = Window.partitionBy(*parts, *upper).orderBy(*_sort_keys(groups[-1])).rowsBetween(
        Window.unboundedPreceding, 0 if own else -1)
    keys = _once(parts, *groups)
    near = totals.select(*keys, *[
        F.sum(f"__ft_total{i}").over(before).alias(f"__ft_before{i}") for i in range(n)])
    if not upper:
        return near
    coarser = totals.groupBy(*parts, *upper).agg(*[
        F.sum(f"__ft_total{i}").alias(f"__ft_total{i}") for i in range(n)])
    far = _offsets(coarser, parts, groups[:-1], n)
    far = far.select(*parts, *upper, *[F.col(f"__ft_before{i}").alias(f"__ft_far{i}") for i in range(n)])
    return near.join(far, parts + upper).select(*keys, *[
        F.when(F.col(f"__ft_before{i}").isNull(), F.col(f"__ft_far{i}"))
        .otherwise(F.col(f"__ft_before{i}") + F.coalesce(f"__ft_far{i}", F.lit(0))).alias(f"__ft_before{i}")
        for i in range(n)])


def running_total(df: DataFrame, value, out: str, order_by: Sequence[str],
                  partition_by: Sequence[str] = (), frame: str = "range") -> DataFrame:
    """OP-13: cumulative series, optionally per partition key."""
    return ordered_measures(df, order_by, [running_sum(out, value, frame)],
                            partition_by=partition_by)


def sequence_rows(df: DataFrame, out: str, order_by: Sequence[str],
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """WIN-1: 1-based position in ``order_by`` order (bigint)."""
    return ordered_measures(df, order_by, [row_number(out)], partition_by=partition_by)


def sorted_result(df: DataFrame, *cols: str) -> DataFrame:
    """SRT-1/2: final ascending sort, NULLS LAST as in the dashboards' engine."""
    return df.orderBy(*_sort_keys(cols))


def with_position(df: DataFrame, out: str = "position") -> DataFrame:
    """1-based place of every row of a sorted report (one row per bucket, so
    few), as the sort left them."""
    seen = df.withColumn("__ft_at", F.monotonically_increasing_id())
    return seen.select(F.row_number().over(Window.orderBy("__ft_at")).cast("bigint").alias(out),
                       *[F.col(f"`{c}`") for c in df.columns])

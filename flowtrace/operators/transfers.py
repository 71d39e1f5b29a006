"""Transfer-level operators (OP-1 … OP-9).

Input rows are individual token transfers or chain transactions. Every
operator is a ``DataFrame -> DataFrame`` function over the canonical
transfer schema produced by :func:`normalize_transfers`:

``tx_hash, block_time, block_date, block_number, sender, receiver,
raw_value, amount, usd``
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import window_predicate
from ..functions.scalars import lit_number, scale_units
from .membership import as_values, either_side, flag_members, touching
from .ordered import ordered_measures, row_number, running_sum


def normalize_transfers(df: DataFrame, *, tx_hash: str, block_time: str, sender: str,
                        receiver: str, value: str, block_number: str | None = None,
                        block_date: str | None = None, decimals: int = 18,
                        price=None, exact: bool = False, safe: bool = False,
                        extra: Sequence[str] = ()) -> DataFrame:
    """OP-1: rename a raw transfer/transaction table to the canonical schema.

    ``amount`` is ``value / 10^decimals`` (double like the dashboards, or an
    exact decimal); ``usd`` is ``amount * price`` when a price is given. With
    ``decimals=0`` an exact amount is the raw integer itself: filters, sums
    and windows over it lose nothing, and reports scale once at the end.
    ``safe=True`` turns raw values that cannot be read as a number of the
    target type into a NULL amount (see :func:`quarantined`) instead of an
    error.
    """
    amount = scale_units(value, decimals, exact=exact, safe=safe) if decimals else (
        F.col(value) if exact else F.col(value).cast("double"))
    cols = [
        F.col(tx_hash).alias("tx_hash"),
        F.col(block_time).alias("block_time"),
        (F.col(block_date) if block_date else F.to_date(block_time)).alias("block_date"),
        (F.col(block_number).cast("bigint") if block_number else F.lit(None).cast("bigint"))
        .alias("block_number"),
        F.col(sender).alias("sender"),
        F.col(receiver).alias("receiver"),
        F.col(value).alias("raw_value"),
        amount.alias("amount"),
    ]
    if price is not None:
        cols.append((amount * lit_number(price, exact)).alias("usd"))
    else:
        cols.append(F.lit(None).cast("double").alias("usd"))
    cols.extend(F.col(c) for c in extra)
    return df.select(*cols)


def quarantined(canonical: DataFrame) -> DataFrame:
    """Rows whose raw value was present but could not be scaled (``safe``
    normalisation): kept aside for inspection instead of dropped silently."""
    return canonical.where(F.col("raw_value").isNotNull() & F.col("amount").isNull())


def severity_tier(df: DataFrame, amount: str, bounds: Sequence, labels: Sequence[str],
                  out: str = "transfer_type") -> DataFrame:
    """OP-2: label each row by size.

    ``bounds = (top, upper, lower)`` and four labels: ``amount > top`` is
    label 0; ``upper <= amount <= top`` label 1; ``lower <= amount <= upper``
    label 2; anything else (and NULL) label 3. Bounds are closed and the first
    match wins, so ``amount == upper`` gets label 1.
    """
    top, upper, lower = bounds
    a = F.col(amount)
    tier = (F.when(a > F.lit(top), F.lit(labels[0]))
             .when(a.between(F.lit(upper), F.lit(top)), F.lit(labels[1]))
             .when(a.between(F.lit(lower), F.lit(upper)), F.lit(labels[2]))
             .otherwise(F.lit(labels[3])))
    return df.withColumn(out, tier)


def above(df: DataFrame, amount: str, minimum) -> DataFrame:
    """FIL-7: strict ``amount > minimum``."""
    return df.where(F.col(amount) > F.lit(minimum))


def raw_floor(raw: str, minimum, decimals: int, exact: bool = False) -> Column:
    """O3: the raw-unit predicate implied by ``raw / 10^decimals > minimum``.

    ``CAST(raw AS DOUBLE) / 1e18 > m`` reaches the Parquet scan only as
    ``IsNotNull``; a comparison of the raw ``decimal(38,0)`` column with a
    literal of the same type is pushed as ``GreaterThan`` and lets row groups
    be skipped on their min/max statistics. In exact mode it is the exact
    comparison of the raw integer (equivalent to the scaled one whenever the
    scaling is lossless); in double mode it is a slightly wider superset
    (the bound is lowered by a relative 1e-9, far beyond double rounding).
    Either way the scaled predicate still runs after it, so it only ever
    removes rows the scaled predicate would remove.
    """
    bound = Decimal(str(minimum)).scaleb(decimals)
    if not exact:
        # Lower the bound (whatever its sign) so the predicate stays a superset.
        bound = bound - abs(bound) * Decimal("1e-9") - 1
    bound = bound.to_integral_value(rounding=ROUND_FLOOR)
    return F.col(raw) > F.lit(bound).cast("decimal(38,0)")


def hop_log(df: DataFrame, min_amount, *, amount: str = "amount",
            order_by: Sequence[str] = ("block_time", "tx_hash"),
            seq_out: str = "hop_sequence", cum_out: str = "cumulative_amount") -> DataFrame:
    """OP-3: keep transfers above ``min_amount``, number them in time order
    and keep a running total of the amount.

    The dashboards order hops by time only; rows of one block share a time
    and rows of one transaction its hash, so ``order_by`` ends with a key that
    is unique (the log index) to make the numbering stable. With a total order the running total by hop number equals the running total by
    ``order_by`` with a ROWS frame, so both come from one ordered pass.
    """
    kept = above(df, amount, min_amount)
    return ordered_measures(kept, order_by,
                            [row_number(seq_out), running_sum(cum_out, amount, frame="rows")])


def in_window(df: DataFrame, time_col: str, start=None, end=None,
              closed: bool = False) -> DataFrame:
    """FIL-1/2/3: closed or half-open time window."""
    return df.where(window_predicate(time_col, start, end, closed=closed))


def watchlist_transfers(df: DataFrame, addresses, *, sender: str = "sender",
                        receiver: str = "receiver", contract_col: str | None = None,
                        contract=None, time_col: str = "block_time", start=None, end=None,
                        closed: bool = False) -> DataFrame:
    """OP-5: transfers of one contract in a time window that touch the
    watchlist on either side."""
    out = in_window(df, time_col, start, end, closed)
    if contract is not None and contract_col is not None:
        out = out.where(F.col(contract_col) == F.lit(contract))
    return either_side(out, (sender, receiver), addresses)


def classify_role(df: DataFrame, origin, suspect, labels: Sequence[str], *,
                  sender: str = "sender", receiver: str = "receiver",
                  out: str = "transfer_type") -> DataFrame:
    """OP-4: origin -> suspect is label 0 (the exploit), anything sent by the
    suspect is label 1 (downstream), the rest label 2.

    ``origin`` and ``suspect`` may be single addresses, lists, or one-column
    watchlist tables.
    """
    s_origin, s_suspect, r_suspect = "__ft_s_origin", "__ft_s_suspect", "__ft_r_suspect"
    work = flag_members(df, sender, {s_origin: origin, s_suspect: suspect})
    work = flag_members(work, receiver, {r_suspect: suspect})
    role = (F.when(F.col(s_origin) & F.col(r_suspect), F.lit(labels[0]))
             .when(F.col(s_suspect), F.lit(labels[1]))
             .otherwise(F.lit(labels[2])))
    return work.withColumn(out, role).drop(s_origin, s_suspect, r_suspect)


def watchlist_roles(df: DataFrame, origin, suspect, labels: Sequence[str], *,
                    sender: str = "sender", receiver: str = "receiver",
                    out: str = "transfer_type") -> DataFrame:
    """OP-5 + OP-4 together: keep rows touching the origin or the suspect on
    either side, and label their role.

    Literal addresses take the ``IN`` path, which reaches the scan. With
    watchlist tables each address column is flagged once against both lists
    (one join per column), and the filter and the role both read those
    flags, instead of separate joins for the filter and for the role. A Bloom
    filter over the lists drops most other rows before these joins.
    """
    if as_values(origin) is not None and as_values(suspect) is not None:
        watch = as_values(origin) + [v for v in as_values(suspect)
                                     if v not in as_values(origin)]
        return classify_role(either_side(df, (sender, receiver), watch), origin, suspect,
                             labels, sender=sender, receiver=receiver, out=out)
    s_o, s_s, r_o, r_s = "__ft_s_o", "__ft_s_s", "__ft_r_o", "__ft_r_s"
    work = touching(df, (sender, receiver), [origin, suspect])
    work = flag_members(work, sender, {s_o: origin, s_s: suspect})
    work = flag_members(work, receiver, {r_o: origin, r_s: suspect})
    work = work.where(F.col(s_o) | F.col(s_s) | F.col(r_o) | F.col(r_s))
    role = (F.when(F.col(s_o) & F.col(r_s), F.lit(labels[0]))
             .when(F.col(s_s), F.lit(labels[1]))
             .otherwise(F.lit(labels[2])))
    return work.withColumn(out, role).drop(s_o, s_s, r_o, r_s)


def drain_progress(df: DataFrame, role_col: str, exploit_label: str, *,
                   amount: str = "amount", order_by: Sequence[str] = ("block_time", "tx_hash"),
                   out: str = "cumulative_drained") -> DataFrame:
    """OP-6: running total of exploit rows only, shown on every row.

    RANGE frame: rows with equal ``order_by`` keys (one transaction's
    transfers in one block) share one total, like the SQL default frame.
    """
    value = F.when(F.col(role_col) == F.lit(exploit_label), F.col(amount)).otherwise(F.lit(0))
    return ordered_measures(df, order_by, [running_sum(out, value, frame="range")])


def flow_direction(df: DataFrame, watched, labels: Sequence[str], *,
                   sender: str = "sender", receiver: str = "receiver",
                   out: str = "flow_direction") -> DataFrame:
    """OP-7: label 0 when the watched address receives (self-transfers
    included), label 1 when it sends, label 2 otherwise."""
    values = as_values(watched)
    if values is None:
        raise ValueError("flow_direction takes literal addresses")
    to_w = F.col(receiver).isin(values) if len(values) > 1 else F.col(receiver) == F.lit(values[0])
    from_w = F.col(sender).isin(values) if len(values) > 1 else F.col(sender) == F.lit(values[0])
    label = (F.when(to_w, F.lit(labels[0])).when(from_w, F.lit(labels[1]))
              .otherwise(F.lit(labels[2])))
    return df.withColumn(out, label)


def large_moves(df: DataFrame, min_amount, *, amount: str = "amount",
                success: str | None = "success") -> DataFrame:
    """OP-8: successful transfers strictly above ``min_amount``. A NULL
    success flag counts as failed."""
    out = df
    if success:
        out = out.where(F.col(success) == F.lit(True))
    return above(out, amount, min_amount)


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None,
           null_aware: bool = True) -> DataFrame:
    """JOI-3: ``left WHERE key NOT IN (SELECT right_key FROM right)``.

    SQL semantics with ``null_aware=True``: an empty right side keeps every
    left row; a NULL anywhere on the right removes every left row; a NULL
    left key is removed otherwise. The NULL check is a one-row aggregate in
    the plan (a scalar subquery); the exclusion is a plain left-anti join,
    which Spark broadcasts when the right side is small and shuffles
    otherwise, unlike a null-aware anti join that must broadcast or fall back
    to a nested loop.
    """
    right_key = right_key or key
    hits, rows, nulls = _hits(right, right_key)
    rest = left.join(hits.where(F.col("__ft_hit").isNotNull()), left[key] == F.col("__ft_hit"), "left_anti")
    if not null_aware:
        return rest.where(F.col(key).isNotNull())
    return rest.where((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))


def _hits(right: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """(distinct keys with their row counts, all rows, rows without a key).
    Keys are aggregated before they are shuffled, so a hot key is one row per
    task; both numbers are sums over that same aggregate."""
    hits = right.groupBy(F.col(key).alias("__ft_hit")).agg(F.count(F.lit(1)).alias("__ft_rows"))
    rows = hits.agg(F.coalesce(F.sum("__ft_rows"), F.lit(0))).scalar()
    nulls = hits.agg(F.coalesce(F.sum(F.when(F.col("__ft_hit").isNull(), F.col("__ft_rows"))), F.lit(0))).scalar()
    return hits, rows, nulls


def merge_without_duplicates(first: DataFrame, second: DataFrame, key: str,
                             null_aware: bool = True) -> DataFrame:
    """OP-9: every row of ``first`` plus the rows of ``second`` whose key is
    not among ``first``'s keys (UNION ALL with NOT IN)."""
    rest = not_in(second, first, key, null_aware=null_aware)
    return first.unionByName(rest.select(*first.columns))


def merge_tagged(df: DataFrame, in_first: str, in_second: str, key: str) -> DataFrame:
    """OP-9 over one frame whose rows are tagged with their legs: rows of the
    first leg, and rows of the second whose key no first-leg row has (NOT IN
    semantics, see :func:`not_in`). Rows stay where they are while the first
    leg's distinct keys are few enough for Spark to broadcast; otherwise the
    join shuffles, and AQE splits a hot key's rows. Rows without a key never
    meet a hit; the NULL rule is a scalar subquery."""
    first, second = F.coalesce(in_first, F.lit(False)), F.coalesce(in_second, F.lit(False))
    hits, rows, nulls = _hits(df.where(first), key)
    flagged = df.join(hits, F.col(key) == F.col("__ft_hit"), "left")
    kept = flagged.where(first | (second & F.col("__ft_rows").isNull()
                                  & ((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))))
    return kept.select(*df.columns)

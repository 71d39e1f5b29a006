"""Watchlist membership: literal lists or watchlist tables.

A handful of addresses (the dashboards' case) become an ``IN`` predicate that
Spark pushes into the Parquet scan. A watchlist *table* (sanctions lists,
clustered wallets) is joined instead. No broadcast hint is forced: Spark
broadcasts the watchlist side only when its size estimate (and, under AQE,
its measured size) is below ``spark.sql.autoBroadcastJoinThreshold``, and
otherwise plans a shuffle join whose hot partitions AQE can split. Several
watchlists checked against the same column share one join: they are merged
into one table of ``(address, flag…)`` first.

Most transfers touch no watchlist. Where only rows with a member on one of two
sides are kept, a Bloom filter over the watchlists (a scalar subquery of fixed
size) is tested on both address columns where the rows are scanned, so that the
exact joins, which decide, see the members and few others: a busy address that
no list holds is never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import any_equal

#: Bits of a Bloom filter (a power of two; 128 KB), one per address: each test
#: is a reference to the subquery, which Spark plans anew, so that more hashes
#: cost more than the few rows they save. It passes 1 % of the others at 10,000
#: addresses; a longer list passes more of them to the joins and changes no result.
BLOOM_BITS = 1 << 20

#: Types whose equal values have equal hashes.
_HASHED = (T.BinaryType(), T.StringType(), T.IntegerType(), T.LongType())

_counter = [0]


def _fresh(prefix: str) -> str:
    _counter[0] += 1
    return f"__ft_{prefix}{_counter[0]}"


def as_values(watch) -> list | None:
    """Literal watchlist -> list; a DataFrame watchlist -> None."""
    if isinstance(watch, DataFrame):
        return None
    if isinstance(watch, (list, tuple, set, frozenset)):
        return list(watch)
    return [watch]


def flag_members(df: DataFrame, col: str, watches: dict[str, object]) -> DataFrame:
    """Add one boolean column per entry of ``watches`` (flag name ->
    watchlist): ``df[col]`` is on that watchlist. NULL addresses are never
    members."""
    out = df
    tables = {}
    for flag, watch in watches.items():
        values = as_values(watch)
        if values is not None:
            out = out.withColumn(flag, F.coalesce(any_equal(col, values), F.lit(False)))
        else:
            tables[flag] = watch
    if not tables:
        return out
    key = _fresh("wkey")
    parts = []
    for flag, watch in tables.items():
        parts.append(watch.select(F.col(watch.columns[0]).alias(key),
                                  *[F.lit(f == flag).alias(f) for f in tables]))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = (merged.where(F.col(key).isNotNull()).groupBy(key)
              .agg(*[F.max(f).alias(f) for f in tables]))
    joined = out.join(merged, out[col] == merged[key], "left")
    return joined.select(*[c for c in out.columns],
                         *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in tables])


def flag_member(df: DataFrame, col: str, watch, flag: str) -> DataFrame:
    """Add boolean ``flag`` = ``df[col]`` is on the watchlist."""
    return flag_members(df, col, {flag: watch})


def _place(value: Column, bits: int) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit(bits - 1))


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(values: DataFrame, bits: int = BLOOM_BITS) -> Column:
    """A Bloom filter over the first column of ``values`` as an array of
    64-bit words: a scalar subquery, so nothing runs while the plan is built.
    Masks are combined per task before they are shuffled; what meets in one
    row is ``bits / 64`` words, however long the list is."""
    address = F.col(values.columns[0])
    masks = values.where(address.isNotNull()).select(_place(address, bits).alias("place")) \
        .select(F.shiftright("place", 6).alias("word"), _mask(F.col("place")).alias("mask"))
    blank = values.sparkSession.range(0, bits // 64, 1, 1).select(
        F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = masks.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "mask")))["mask"]).scalar()


def might_contain(bloom: Column, value: Column, bits: int = BLOOM_BITS) -> Column:
    """False only if no value of the filter's list equals ``value``."""
    place = _place(value, bits)
    return F.get(bloom, F.shiftright(place, 6).cast("int")).bitwiseAND(_mask(place)) != 0


def touching(df: DataFrame, cols: tuple[str, str], watches: list, bits: int = BLOOM_BITS) -> DataFrame:
    """Rows that may have a member of one of ``watches`` (lists or tables) on
    one side: all that do, and few others. All rows where a table's type
    differs from the columns', as equal values may then hash differently."""
    types = {df.schema[c].dataType for c in cols}
    tables = [w for w in watches if as_values(w) is None]
    types |= {w.schema[0].dataType for w in tables}
    if len(types) > 1 or types.pop() not in _HASHED:
        return df
    literal = [v for w in watches for v in as_values(w) or ()]
    kept = F.lit(False)
    if literal:
        kept = any_equal(cols[0], literal) | any_equal(cols[1], literal)
    if tables:
        every = reduce(DataFrame.unionByName, (
            w.select(F.col(w.columns[0]).alias("__ft_address")) for w in tables))
        bloom = bloom_filter(every, bits)
        for c in cols:
            kept = kept | might_contain(bloom, F.col(c), bits)
    return df.where(F.coalesce(kept, F.lit(False)))


def either_side(df: DataFrame, cols: tuple[str, str], watch) -> DataFrame:
    """FIL-11: keep rows where either address column is on the watchlist."""
    values = as_values(watch)
    if values is not None:
        return df.where(any_equal(cols[0], values) | any_equal(cols[1], values))
    df = touching(df, cols, [watch])
    f0, f1 = _fresh("side"), _fresh("side")
    tagged = flag_member(flag_member(df, cols[0], watch, f0), cols[1], watch, f1)
    return tagged.where(F.col(f0) | F.col(f1)).drop(f0, f1)


def member_condition(df: DataFrame, col: str, watch) -> tuple[DataFrame, Column]:
    """(frame, predicate) for ``col`` on the watchlist; joins only for tables."""
    values = as_values(watch)
    if values is not None:
        return df, any_equal(col, values)
    flag = _fresh("wflag")
    return flag_member(df, col, watch, flag), F.col(flag)

import datetime as dt
import hashlib
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowtrace.operators import ordered_measures, row_number, running_sum

from .conftest import SF_SMALL


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plain(df, order_by, out, value, partition_by=(), frame="range"):
    """The SQL window itself."""
    spec = Window.partitionBy(*partition_by).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    if frame == "rows":
        spec = spec.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.row_number().over(spec).cast("bigint") if value is None
                         else F.sum(value).over(spec))


def _lines(spark):
    return spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_returnflag",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amt"))


def test_equals_window_with_heavy_ties(spark):
    li = _lines(spark)
    assert _same(ordered_measures(li, ["l_shipdate"], [running_sum("c", "amt")]),
                 plain(li, ["l_shipdate"], "c", "amt"))
    unique = ["l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber"]
    got = ordered_measures(li, unique, [row_number("rn"), running_sum("c", "amt", "rows")])
    want = plain(plain(li, unique, "rn", None), unique, "c", "amt", frame="rows")
    assert _same(got, want)


def test_partitioned_equals_window(spark):
    li = _lines(spark)
    got = ordered_measures(li, ["l_shipdate", "l_suppkey"], [running_sum("c", "amt")],
                           partition_by=["l_returnflag"])
    assert _same(got, plain(li, ["l_shipdate", "l_suppkey"], "c", "amt", ["l_returnflag"]))


def test_text_keys(spark):
    li = _lines(spark).withColumn("s", F.col("l_suppkey").cast("string"))
    assert _same(ordered_measures(li, ["s"], [running_sum("c", "amt")]), plain(li, ["s"], "c", "amt"))


rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)),
                          st.one_of(st.none(), st.integers(-50, 50)),
                          st.sampled_from(["a", "b", None])), min_size=0, max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows)
def test_property_equals_window(spark, data):
    df = spark.createDataFrame(
        [(None if k is None else dt.datetime(2026, 4, 18) + dt.timedelta(hours=9 * k),
          None if v is None else Decimal(v), p) for k, v, p in data],
        "t timestamp, v decimal(10,0), p string")
    for part in ([], ["p"]):
        assert _same(ordered_measures(df, ["t"], [running_sum("c", "v")], partition_by=part),
                     plain(df, ["t"], "c", "v", part))


def test_numbers_do_not_depend_on_the_layout(spark):
    """Many transfers share (time, hash); the log index makes the order total.
    Doubles accumulate exactly, so even their totals are the same."""
    data = [(dt.datetime(2026, 4, 18, 17), bytes([i % 3]), i, (i * 7919 % 1000) / 7) for i in range(900)]
    df = spark.createDataFrame(data, "t timestamp, h binary, i int, v double")
    out = [ordered_measures(df.repartition(n), ["t", "h", "i"],
                            [row_number("rn"), running_sum("c", "v", "rows")]).orderBy("rn").collect()
           for n in (1, 64)]
    assert out[0] == out[1] and [r.rn for r in out[0]] == list(range(1, 901))


def test_hot_key_results(spark):
    # A third of the rows share one (time, hash) key; the rest are distinct.
    hot = [(dt.datetime(2026, 4, 18, 17, 37), b"\x01", Decimal(i % 7)) for i in range(1000)]
    rest = [(dt.datetime(2026, 4, 18) + dt.timedelta(seconds=i), bytes([2 + i % 200]),
             Decimal(i % 11)) for i in range(2000)]
    df = spark.createDataFrame(hot + rest, "t timestamp, h binary, v decimal(10,0)")
    assert _same(ordered_measures(df, ["t", "h"], [running_sum("c", "v")]),
                 plain(df, ["t", "h"], "c", "v"))
    rn = ordered_measures(df, ["t", "h"], [row_number("rn"), running_sum("c", "v", "rows")])
    assert sorted(r.rn for r in rn.collect()) == list(range(1, 3001))


def _largest_share(spark, df):
    """The largest part of the rows that one of 64 tasks ends up with."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return max(sizes) / sum(sizes)


def _moves(spark, hot, rest):
    day = dt.datetime(2026, 4, 18)
    return spark.createDataFrame(
        hot + [(day + dt.timedelta(seconds=i), hashlib.sha256(b"r%d" % i).digest(), i % 5, Decimal(i % 11 - 5))
               for i in range(rest)], "t timestamp, h binary, i int, v decimal(10,0)")


def test_hot_instant_spreads_over_tasks(spark):
    """A third of all rows in one block: its hashes cut it, and every result
    is that of the plain window, for 1 and 64 input partitions."""
    at = dt.datetime(2026, 4, 18, 17, 37)
    df = _moves(spark, [(at, hashlib.sha256(b"h%d" % (i // 2)).digest(), i % 2, Decimal(i % 7)) for i in range(2000)],
                4000)
    for keys, frame in ((["t", "h"], "range"), (["t", "h", "i"], "rows")):
        results = [ordered_measures(df.repartition(n), keys, [running_sum("c", "v", frame)]) for n in (1, 64)]
        want = plain(df, keys, "c", "v", frame=frame)
        assert all(_same(r, want) for r in results)
        assert _largest_share(spark, results[1]) < 0.1


def test_hot_transaction_is_cut_by_its_log_indexes(spark):
    at, one = dt.datetime(2026, 4, 18, 17, 37), hashlib.sha256(b"one").digest()
    df = _moves(spark, [(at, one, i, Decimal(i % 7)) for i in range(65536)], 1000)
    out = ordered_measures(df, ["t", "h", "i"], [row_number("rn"), running_sum("c", "v", "rows")])
    want = plain(plain(df, ["t", "h", "i"], "rn", None), ["t", "h", "i"], "c", "v", frame="rows")
    assert _same(out, want)
    assert _largest_share(spark, out) < 0.5


def test_digits_keep_the_order_of_negative_null_and_short_keys(spark):
    data = [(None if i % 7 == 0 else dt.datetime(2026, 4, 18, i % 3), None if i % 5 == 0 else s, n, Decimal(i))
            for i, (s, n) in enumerate((s, n) for s in ("", "a", "abcd", "abcde", "ab", "é", "\U0001f600b", "zz")
                                       for n in (-5000, -4096, -1, 0, 4095, 4096, None, 9000))]
    df = spark.createDataFrame(data, "t timestamp, s string, n int, v decimal(10,0)")
    df = df.withColumn("b", F.col("s").cast("binary"))
    for keys in (["t", "s", "n"], ["t", "b", "n"], ["t", "n", "s"], ["s", "n", "t"], ["t", "n"], ["n", "t", "s"]):
        for frame in ("range", "rows"):
            unique = keys if frame == "range" else [*keys, "v"]
            assert _same(ordered_measures(df, unique, [running_sum("c", "v", frame)]),
                         plain(df, unique, "c", "v", frame=frame)), (keys, frame)

"""Wide integers, order-independent sums, places, NOT IN and partition bounds."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowtrace.functions import wide
from flowtrace.functions.double_sum import double_sum
from flowtrace.functions.predicates import partition_bound
from flowtrace.operators import findings, series, transfers
from flowtrace.operators.ordered import sorted_result, with_position
from flowtrace.plans import recipes as R
from flowtrace.sources import bindings as B
from flowtrace.sources.tables import read_chain_table, write_chain_table

from .conftest import SF_SMALL


def number(limbs):
    return sum(int(x) << (64 * k) for k, x in zip((3, 2, 1, 0), (limbs.l3, limbs.l2, limbs.l1, limbs.l0)))


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(1)
    values = [0, 1, 2 ** 56, 2 ** 64 - 1, 2 ** 64, 2 ** 126 - 1, 2 ** 126, 2 ** 128, 2 ** 192 - 1, 2 ** 255, 2 ** 256 - 1]
    values += [rng.randrange(2 ** rng.randint(1, 256)) for _ in range(200)]
    rows = [(str(v), v.to_bytes(rng.choice([(v.bit_length() + 7) // 8 or 1, 32, 40]), "big")
             if v.bit_length() <= 256 else None) for v in values]
    rows += [("0", b""), (None, None), (None, b"\x01" + bytes(32))]
    return spark.createDataFrame(rows, "v string, d binary").withColumn("w", wide.limbs("d"))


def test_wide_values_equal_python_integers(words):
    rows = words.select(
        "v", "w", wide.to_decimal("w").alias("dec"), wide.to_double("w").alias("dbl"), wide.to_hex("w").alias("hex"),
        wide.above_word("d", 2 ** 200).alias("as_bytes"), (F.col("w") > wide.literal(2 ** 200)).alias("as_limbs"),
        wide.above_word("d", 2 ** 256).alias("never"), wide.above_word("d", -1).alias("always")).collect()
    for r in rows:
        if r.v is None:
            assert r.w.l0 is None and r.hex is None and not r.as_bytes
            continue
        v = int(r.v)
        assert number(r.w) == v == int(r.hex, 16)
        assert r.dec == (v if v < 2 ** 126 else None)
        assert abs(r.dbl - v) <= 1e-15 * v
        assert r.as_bytes == r.as_limbs == (v > 2 ** 200) and not r.never and r.always


@pytest.mark.parametrize("parts", [1, 64])
def test_wide_sums_carry_and_merge(words, parts):
    known = words.where("v is not null").repartition(parts)
    total = sum(int(r.v) for r in known.select("v").collect())
    row = wide.carry(known.agg(wide.sum_limbs("w").alias("s"), F.max("w").alias("top"), F.min("w").alias("low")), "s") \
        .select("*", wide.to_hex("s", carried=True).alias("hex"), wide.to_double("s", carried=True).alias("dbl")).first()
    assert int(row.hex, 16) == total and abs(row.dbl - total) <= 1e-15 * total
    assert number(row.top) == 2 ** 256 - 1 and number(row.low) == 0


def test_double_sums_have_the_same_bits_in_any_layout(spark):
    rng = random.Random(2)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-12, 28) for _ in range(3000)]
    values += [1e16, 1.0, -1e16, 0.1, 2.0 ** -60, None]
    sums = set()
    for parts in (1, 7, 64):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        sums.add(df.agg(double_sum("v")).first()[0])
    want = math.fsum(v for v in values if v is not None)
    assert len(sums) == 1 and abs(sums.pop() - want) <= 2 * math.ulp(want)
    odd = spark.createDataFrame([(1.0, float("inf"), float("nan"), 1e300, None), (2.0, 1.0, 1.0, 1e300, None)],
                                "a double, b double, c double, d double, e double")
    row = odd.agg(*(double_sum(c).alias(c) for c in odd.columns)).first()
    assert row.a == 3.0 and row.b == math.inf and math.isnan(row.c) and row.d == 2e300 and row.e is None


@pytest.mark.parametrize("parts", [1, 64])
def test_default_mode_series_do_not_depend_on_the_layout(spark, parts):
    def leg(df):
        return df.withColumn("amount", F.col("amount").cast("double") / 3) \
            .withColumn("amount_usd", F.col("amount_usd").cast("double") / 7).repartition(parts)

    legs = [leg(B.lending_supply(spark, SF_SMALL)), leg(B.lending_borrow(spark, SF_SMALL))]
    aligned = series.bucket_legs([(df, "block_time", {f"s{i}": ("sum", "amount")}) for i, df in enumerate(legs)], "day")
    got = sorted(map(tuple, aligned.collect()))
    want = {}
    for i, df in enumerate(legs):
        for r in df.select(F.date_trunc("day", "block_time").cast("timestamp_ntz").alias("b"), "amount").collect():
            want.setdefault(r.b, ([], []))[i].append(r.amount)
    assert [b for b, *_ in got] == sorted(want)
    for b, *sums in got:
        for s, values in zip(sums, want[b]):
            assert abs(s - math.fsum(values)) <= 2 * math.ulp(s)
    seen = test_default_mode_series_do_not_depend_on_the_layout.__dict__.setdefault("seen", got)
    assert got == seen


def test_largest_row_has_its_place_and_total(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([None, Decimal(5), Decimal(rng.randint(1, 9))])) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, i int, amount decimal(38,0)").repartition(5)
    got = findings.largest_with_place(df, "amount", ("t", "i"), "hop", "total").first()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    at = max((k for k, r in enumerate(ordered) if r[2] is not None), key=lambda k: (ordered[k][2], -k))
    assert (got.t, got.i, got.amount) == ordered[at] and got.hop == at + 1
    assert got.total == sum(r[2] or 0 for r in ordered[:at + 1])
    assert findings.largest_with_place(df.where("amount is null"), "amount", ("t", "i"), "hop", "total").count() == 0


def test_positions_follow_the_sort(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x.y") for i in range(101)], "`a.b` int, c string").repartition(9)
    rows = with_position(sorted_result(df.withColumnRenamed("a.b", "k"), "k").withColumnRenamed("k", "a.b")).collect()
    assert [(r.position, r["a.b"]) for r in sorted(rows)] == [(i + 1, i) for i in range(101)]


@pytest.mark.parametrize("firsts", [[], [(1,), (1,)], [(1,), (None,)]])
def test_not_in_forms_agree_with_hot_and_missing_keys(spark, firsts):
    second = [(1,)] * 500 + [(2,)] * 300 + [(None,)] * 200 + [(3,)]
    first_df = spark.createDataFrame(firsts, "k int")
    second_df = spark.createDataFrame(second, "k int").repartition(7)
    keys = [k for k, in firsts]
    kept = [k for k, in second if not keys or (None not in keys and k is not None and k not in keys)]
    key = lambda k: (k is None, k or 0)
    assert sorted((r.k for r in transfers.not_in(second_df, first_df, "k").collect()), key=key) == sorted(kept, key=key)
    merged = transfers.merge_without_duplicates(first_df, second_df, "k")
    assert sorted((r.k for r in merged.collect()), key=key) == sorted(keys + kept, key=key)
    tagged = first_df.selectExpr("k", "true as a", "false as b").unionByName(
        second_df.selectExpr("k", "false as a", "true as b"))
    out = transfers.merge_tagged(tagged, "a", "b", "k")
    assert out.columns == ["k", "a", "b"]
    assert sorted((r.k for r in out.collect()), key=key) == sorted(keys + kept, key=key)


def test_not_in_needs_no_window_over_candidates(spark):
    df = spark.range(10).selectExpr("id as k", "id < 3 as a", "id > 1 as b")
    plan = transfers.merge_tagged(df, "a", "b", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan


def test_partition_bounds_hold_exactly_the_keys_of_the_window(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(120)]
    df = spark.createDataFrame([(d, d.replace(day=1)) for d in days], "d date, m date")
    D = dt.datetime
    for start, end, closed in ((D(2024, 1, 31, 5), D(2024, 2, 2), False), (D(2024, 2, 1), D(2024, 3, 1), False),
                               (D(2024, 2, 1), D(2024, 3, 1, 0, 0, 1), False), (dt.date(2024, 2, 1), dt.date(2024, 2, 9), True),
                               (dt.date(2024, 2, 1), dt.date(2024, 2, 9), False), (None, D(2024, 2, 2), False), (D(2024, 4, 2), None, False)):
        def touched(first, last):  # does [first, last) meet the window?
            low = D.min if start is None else D.combine(start, dt.time()) if not isinstance(start, D) else start
            high = D.max if end is None else D.combine(end, dt.time()) if not isinstance(end, D) else end
            if closed:
                high += dt.timedelta(days=1)
            return first < high and last > low

        day = [d for d in days if touched(D.combine(d, dt.time()), D.combine(d, dt.time()) + dt.timedelta(1))]
        got = [r.d for r in df.where(partition_bound("d", start, "date", end, closed)).collect()]
        assert got == day
        months = {r.m for r in df.where(partition_bound("m", start, "month", end, closed)).collect()}
        assert months == {d.replace(day=1) for d in day}


def test_windows_prune_partitions_at_both_ends(spark, scratch):
    window = (dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1))
    for name, build, recipe in (
            ("erc20_evt_transfer", B.erc20_evt_transfer, lambda t: R.bridge_drain(t, window=window)),
            ("thorchain_swaps", B.thorchain_swaps, lambda t: R.swap_log(t, window=window)),
            ("lending_supply", B.lending_supply, lambda t: R.aave_contagion(
                t, t, window=(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))))):
        path = f"{scratch}/both_{name}"
        write_chain_table(build(spark, SF_SMALL), path, name)
        plan = recipe(read_chain_table(spark, name, path))._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert ">=" in filters and "<" in filters.replace("<=", "<").replace(">=", "")

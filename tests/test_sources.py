import datetime as dt

from flowtrace.operators.ordered import sorted_result
from flowtrace.sources import bindings as B
from flowtrace.sources.tables import read_chain_table, write_chain_table, write_result

from .conftest import SF_SMALL


def test_sort_is_nulls_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r.k for r in sorted_result(df, "k").collect()] == [1, 2, None]
    big = spark.range(5).selectExpr("CAST(NULL AS INT) AS k").union(df)
    assert [r.k for r in sorted_result(big, "k").collect()][:2] == [1, 2]
    out = sorted_result(big, "k")
    assert "rangepartitioning" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in out.collect()] == [1, 2] + [None] * 6


def test_chain_table_round_trip_keeps_rows_and_prunes(spark, scratch):
    path = f"{scratch}/rseth_roundtrip"
    src = B.rseth_evt_transfer(spark, SF_SMALL)
    write_chain_table(src, path, "rseth_evt_transfer")
    back = read_chain_table(spark, "rseth_evt_transfer", path)
    assert back.count() == src.count()
    assert back.exceptAll(src.select(*back.columns).withColumn(
        "evt_block_time", src.evt_block_time.cast("timestamp"))).count() == 0
    day = back.where(back.evt_block_date == dt.date(2024, 1, 5))
    assert "PartitionFilters: [isnotnull(evt_block_date" in \
        day._jdf.queryExecution().executedPlan().toString()


def test_write_result_csv(spark, scratch):
    path = f"{scratch}/csv_out"
    write_result(spark.createDataFrame([(1, "a")], "n int, s string"), path, fmt="csv")
    back = spark.read.option("header", "true").csv(path)
    assert back.columns == ["n", "s"] and back.count() == 1


def test_runner_writes_results(spark, scratch):
    from flowtrace.plans.run import main
    out = f"{scratch}/run_out"
    main(["--sf-dir", SF_SMALL, "--out", out, "--csv", "recovery", "fund_destinations"])
    back = spark.read.option("header", "true").csv(f"{out}/fund_destinations")
    assert back.count() > 0 and "resting_value" in back.columns


def test_register_dashboards_as_sql_views(spark):
    from flowtrace.plans.bound import PARAMS
    from flowtrace.plans.recipes import kill_chain_edges
    from flowtrace.plans.views import register_dashboards
    tables = {"rseth_evt_transfer": B.rseth_evt_transfer(spark, SF_SMALL),
              "kill_chain_edges": kill_chain_edges(spark)}
    p = PARAMS["hop_log"]
    names = register_dashboards(spark, tables, params={"inception_hop_log": dict(
        dates=p["dates"], min_amount=p["min_amount"], bounds=p["bounds"], exact=True)},
        prefix="ft_")
    assert names == ["ft_inception_hop_log", "ft_kill_chain_summary"]
    n = spark.sql("SELECT count(*) AS n FROM ft_inception_hop_log").first().n
    assert n == 691
    top = spark.sql("SELECT pct_of_total FROM ft_kill_chain_summary WHERE step = 4").first()
    assert top.pct_of_total == 26.4

    labelled = register_dashboards(spark, {"kill_chain_edges": kill_chain_edges(spark)},
                                   prefix="ftl_", labelled=True)
    assert labelled == ["ftl_kill_chain_summary"]
    row = spark.sql("SELECT `% of Total Exploit` AS p FROM ftl_kill_chain_summary "
                    "WHERE `Step` = 3").first()
    assert row.p == 65.1


def test_scale_settings_bounds():
    from flowtrace.session import scale_settings
    big = scale_settings(100 * 2 ** 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // 2 ** 28
    small = scale_settings(37 * 2 ** 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # three waves of 8 cores
    mid = scale_settings(512 * 2 ** 30, 64)
    assert int(mid["spark.sql.shuffle.partitions"]) == 2048  # 512 GiB / 256 MiB
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"

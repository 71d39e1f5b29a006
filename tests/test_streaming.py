from pyspark.sql import functions as F

from flowtrace.operators import bucket_flow
from flowtrace.sources import bindings as B
from flowtrace.streaming import stream_bucket_flow

from .conftest import SF_SMALL


def test_stream_matches_batch_for_closed_buckets(spark, scratch):
    path = f"{scratch}/lending_supply_stream"
    supply = B.lending_supply(spark, SF_SMALL)
    supply.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(supply.schema).parquet(path)
    measures = {"n": F.count(F.lit(1)), "volume": F.sum("amount")}
    live = stream_bucket_flow(stream, "block_time", "hour", measures, lateness="1 hour")
    q = (live.writeStream.outputMode("append").format("memory").queryName("ft_live_supply")
         .option("checkpointLocation", f"{scratch}/ft_live_ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {(r.bucket, r.n, r.volume) for r in spark.sql("SELECT * FROM ft_live_supply").collect()}
    batch = bucket_flow(supply, "block_time", "hour", measures)
    want = {(r.bucket, r.n, r.volume) for r in batch.collect()}
    # Append mode emits a bucket once the watermark has passed it: every
    # emitted bucket equals the batch result, and only the newest buckets
    # (within the lateness) are still open.
    assert got and got <= want
    assert len(want) - len(got) <= 2



def test_stream_watchlist_roles_match_batch(spark, scratch):
    from flowtrace.operators import normalize_transfers, watchlist_roles
    from flowtrace.plans import constants as K
    from flowtrace.streaming import stream_watchlist_roles

    path = f"{scratch}/erc20_stream"
    src = B.erc20_evt_transfer(spark, SF_SMALL)
    src.write.mode("overwrite").parquet(path)
    canon = lambda df: normalize_transfers(df, tx_hash="tx_hash", block_time="block_time",
                                           sender="from", receiver="to", value="value",
                                           exact=True)
    origin = spark.createDataFrame([((7).to_bytes(20, "big"),)], "address binary")
    suspect = spark.createDataFrame([((3).to_bytes(20, "big"),)], "address binary")
    live = stream_watchlist_roles(canon(spark.readStream.schema(src.schema).parquet(path)),
                                  origin, suspect, K.ROLE_LABELS)
    q = (live.select("tx_hash", "sender", "receiver", "amount", "transfer_type")
         .writeStream.outputMode("append").format("memory").queryName("ft_live_roles")
         .option("checkpointLocation", f"{scratch}/ft_roles_ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM ft_live_roles")
    want = watchlist_roles(canon(src), origin, suspect, K.ROLE_LABELS).select(*got.columns)
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_reopen_their_bucket(spark, scratch):
    """Partials of every micro-batch merge to the batch result, whatever
    the order in which rows arrive; a repeated batch counts once."""
    import datetime as dt
    import random
    import uuid

    from flowtrace.streaming.monitor import compact_partials, merged_buckets, start_bucket_partials

    rng, base = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=rng.randrange(5000)), rng.choice("ab"), rng.random() * 10 ** rng.randint(0, 9))
            for _ in range(400)]
    folder = f"{scratch}/{uuid.uuid4().hex}"
    schema = "block_time timestamp_ntz, k string, amount double"
    measures = {"n": ("count", None), "total": ("sum", "amount"), "low": ("min", "amount"), "high": ("max", "amount")}
    for part in range(4):  # out of order: any batch may hold the oldest rows
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = start_bucket_partials(stream, "block_time", "hour", measures, f"{folder}/out", f"{folder}/state",
                                  keys=["k"], trigger={"availableNow": True})
    query.awaitTermination(120)
    got = sorted(map(tuple, merged_buckets(spark, f"{folder}/out", measures, keys=["k"]).collect()))
    want = {}
    for t, k, v in rows:
        want.setdefault((t.replace(minute=0), k), []).append(v)
    assert [r[:4] for r in got] == [(b, k, len(v), r[3]) for (b, k), v, r in
                                    zip(sorted(want), (want[x] for x in sorted(want)), got)]
    for b, k, _, total, low, high in got:
        values = want[b, k]
        assert abs(total - sum(values)) <= 1e-9 * abs(total) and (low, high) == (min(values), max(values))
    compact_partials(spark, f"{folder}/out", f"{folder}/compact", measures, keys=["k"])
    assert sorted(map(tuple, merged_buckets(spark, f"{folder}/compact", measures, keys=["k"]).collect())) == got

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.tables import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b), the smallest
    node that it reaches. Each step is an aggregate and a join that Spark may
    split where one node has very many edges; nothing is gathered per node.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = stored(links.distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        earlier, links = links, stored(small.where("u <> v"), "links")
        release(earlier)
    stars = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = links.select("v").distinct()
    return stars.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component")))

"""Flow-graph accounting (OP-19, OP-20, RD-1, RD-2).

An edge table is ``(source_node, target_node, value)``. Node accounting
emits both ends of every edge in one pass and aggregates once (partial
aggregation before the shuffle), so a node with a third of all edges still
costs one pre-aggregated row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import sequence_rows


def number_edges(edges: DataFrame, order_by: Sequence[str] = ("source_node", "target_node"),
                 out: str = "step") -> DataFrame:
    """Give an edge table a stable step number (distributed row number)."""
    return sequence_rows(edges, out, order_by)


def flow_edges(edges: DataFrame, *, value: str = "value", total=None,
               out: str = "pct_of_total", digits: int = 1) -> DataFrame:
    """OP-19: edge table with each edge's share of a total, in percent.

    ``total`` is the exploit total (a constant in the dashboards). Without it
    the sum of all edge values is used: a distributed aggregate in the plan (a
    scalar subquery), never a window over the whole table.
    """
    whole = edges.agg(F.sum(value)).scalar() if total is None else F.lit(float(total))
    pct = F.round(F.try_divide(F.col(value).cast("double"), whole.cast("double"))
                  * F.lit(100.0), digits)
    return edges.withColumn(out, pct)


def _edge_ends(edges: DataFrame, value: str, fields) -> DataFrame:
    """Two rows per edge (source end, target end) in one pass over the edge
    table: an ``explode`` of a two-element array, not a union of two scans
    (a union's branches prune columns differently, so Spark would evaluate
    the edge table, and the joins behind it, twice)."""
    v = F.col(value)
    zero = F.lit(0).cast(edges.schema[value].dataType)
    ends = F.array(
        F.struct(F.col("source_node").alias("node"), *[f(v, zero, "out").alias(n)
                                                       for n, f in fields]),
        F.struct(F.col("target_node").alias("node"), *[f(v, zero, "in").alias(n)
                                                       for n, f in fields]))
    return edges.select(F.explode(ends).alias("_e")).select("_e.*")


def node_totals(edges: DataFrame, value: str = "value", out: str = "total") -> DataFrame:
    """OP-20: one row per (node, direction) with the summed edge value;
    direction is ``out`` for outgoing and ``in`` for incoming edges."""
    ends = _edge_ends(edges, value, [("direction", lambda v, z, d: F.lit(d)),
                                     ("_v", lambda v, z, d: v)])
    return ends.groupBy("node", "direction").agg(F.sum("_v").alias(out))


def node_balances(edges: DataFrame, value: str = "value") -> DataFrame:
    """Per node: total in, total out and balance = in - out."""
    ends = _edge_ends(edges, value, [
        ("_in", lambda v, z, d: v if d == "in" else z),
        ("_out", lambda v, z, d: v if d == "out" else z),
        ("_v", lambda v, z, d: v if d == "in" else -v)])
    return (ends.groupBy("node")
            .agg(F.sum("_in").alias("total_in"), F.sum("_out").alias("total_out"),
                 F.sum("_v").alias("balance")))


def fund_destinations(edges: DataFrame, value: str = "value") -> DataFrame:
    """RD-1: where the money rests. Nodes that received more than they
    sent, with that surplus; on the dashboards' kill-chain edges these are
    the freeze, the cold wallets, the Tron leg and the Aave residual."""
    return (node_balances(edges, value).where(F.col("balance") > 0)
            .select("node", F.col("balance").alias("resting_value")))


def recovery(edges: DataFrame, recovered_nodes: Sequence, value: str = "value",
             labels: Sequence[str] = ("recovered", "at_risk")) -> DataFrame:
    """RD-2: split the resting value into recovered (frozen, returned) and
    at-risk: amount and number of resting nodes per status."""
    dest = fund_destinations(edges, value)
    status = F.when(F.col("node").isin(list(recovered_nodes)), F.lit(labels[0])) \
              .otherwise(F.lit(labels[1]))
    return (dest.withColumn("status", status).groupBy("status")
            .agg(F.sum("resting_value").alias("amount"), F.count(F.lit(1)).alias("nodes")))

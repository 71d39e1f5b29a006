"""Expose the dashboard recipes to Spark SQL as temporary views.

    register_dashboards(spark, {"rseth_evt_transfer": df, "lending_supply": df2, ...})
    spark.sql("SELECT * FROM inception_hop_log WHERE classification LIKE '%Primary%'")

A view is registered for every dashboard whose source tables are given;
``params`` overrides recipe arguments per dashboard. Building a view runs
the same size checks as calling the recipe (checkpoint jobs included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import constants as K
from . import recipes as R

# dashboard view -> (recipe, source tables in argument order, column labels)
DASHBOARDS = {
    "inception_hop_log": (R.inception_hop_log, ("rseth_evt_transfer",), K.HOP_LOG_LABELS),
    "bridge_drain": (R.bridge_drain, ("erc20_evt_transfer",), {}),
    "aave_contagion": (R.aave_contagion, ("lending_supply", "lending_borrow"),
                       K.CONTAGION_LABELS),
    "aave_tvl_drop": (R.aave_tvl_drop, ("lending_supply", "lending_borrow"), K.TVL_LABELS),
    "arbitrum_intervention": (R.arbitrum_intervention, ("arbitrum_transactions",),
                              K.INTERVENTION_LABELS),
    "laundering_path": (R.laundering_path, ("thorchain_swaps", "tron_logs"),
                        K.LAUNDERING_LABELS),
    "laundering_path_v2": (R.laundering_path_v2, ("thorchain_swaps", "tron_transactions"),
                           K.LAUNDERING_V2_LABELS),
    "kill_chain_summary": (R.kill_chain_summary, ("kill_chain_edges",), K.KILL_CHAIN_LABELS),
}


def register_dashboards(spark: SparkSession, tables: dict[str, DataFrame],
                        params: dict[str, dict] | None = None, prefix: str = "",
                        labelled: bool = False) -> list[str]:
    """Register one temporary view per dashboard whose inputs are present;
    returns the view names. ``labelled=True`` uses the dashboards' column
    labels (quote them with backticks in SQL)."""
    params = params or {}
    names = []
    for view, (recipe, sources, labels) in DASHBOARDS.items():
        if not all(s in tables for s in sources):
            continue
        df = recipe(*[tables[s] for s in sources], **params.get(view, {}))
        if labelled:
            df = R.display(df, labels)
        df.createOrReplaceTempView(prefix + view)
        names.append(prefix + view)
    return names

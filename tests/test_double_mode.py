"""The dashboards' own double arithmetic (``exact=False``, the recipe
default) against DuckDB evaluating the same double expressions. Rounding a
double can land one unit apart between engines on ties, so numbers are
compared to one unit in the last rounded place."""

import math

from flowtrace.plans import recipes as R
from flowtrace.plans.bound import PARAMS
from .compare import duckdb_connection
from flowtrace.sources import bindings as B

from .conftest import SF_SMALL


def _close(a, b, tol):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, abs_tol=tol)
    return a == b


def test_hop_log_double_mode(spark):
    p = PARAMS["hop_log"]
    got = R.inception_hop_log(B.rseth_evt_transfer(spark, SF_SMALL), dates=p["dates"],
                              min_amount=p["min_amount"], bounds=p["bounds"],
                              price=p["price"]).collect()
    con = duckdb_connection(SF_SMALL)
    want = con.execute(f"""
      WITH raw AS (
        SELECT user_id, event_id, date_trunc('hour', ts) AS block_time,
               CAST(CAST(CAST(value AS DECIMAL(18,2)) * 1000000000000000000 AS DECIMAL(38,0))
                    + event_id AS DOUBLE) / 1e18 AS amount
        FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '{p['dates'][0]}' AND DATE '{p['dates'][1]}'),
      hops AS (
        SELECT *, amount * {p['price']} AS usd,
               ROW_NUMBER() OVER (ORDER BY block_time, user_id, event_id) AS hop_sequence
        FROM raw WHERE amount > {p['min_amount']})
      SELECT hop_sequence, ROUND(amount, 4), ROUND(usd / 1e6, 3),
             ROUND(SUM(amount) OVER (ORDER BY hop_sequence), 2)
      FROM hops ORDER BY hop_sequence""").fetchall()
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert g.hop_sequence == w[0]
        assert _close(g.rseth_amount, w[1], 1e-4)
        assert _close(g.usd_value_m, w[2], 1e-3)
        assert _close(g.cumulative_rseth_drained, w[3], 1e-2)


def test_contagion_double_mode(spark):
    w0, w1 = PARAMS["contagion"]["window"]
    supply = B.lending_supply(spark, SF_SMALL)
    borrow = B.lending_borrow(spark, SF_SMALL)
    # The dashboards' lending tables hold doubles.
    supply = supply.withColumn("amount", supply.amount.cast("double")) \
                   .withColumn("amount_usd", supply.amount_usd.cast("double"))
    borrow = borrow.withColumn("amount", borrow.amount.cast("double")) \
                   .withColumn("amount_usd", borrow.amount_usd.cast("double"))
    got = {r.hour_bucket: r for r in R.aave_contagion(supply, borrow, window=(w0, w1)).collect()}
    con = duckdb_connection(SF_SMALL)
    rows = con.execute(f"""
      WITH e AS (SELECT ts, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount,
                        CAST(CAST(value AS DECIMAL(18,2)) * 2506.5 AS DOUBLE) AS usd
                 FROM events WHERE ts >= TIMESTAMP '{w0}' AND ts < TIMESTAMP '{w1}'),
      s AS (SELECT date_trunc('hour', ts) h, SUM(amount) a, SUM(usd) u FROM e
            WHERE event_type IN ('purchase', 'error') GROUP BY 1),
      b AS (SELECT date_trunc('hour', ts) h, SUM(amount) a, SUM(usd) u FROM e
            WHERE event_type IN ('signup', 'click') GROUP BY 1),
      c AS (SELECT COALESCE(s.h, b.h) h, COALESCE(s.a, 0) sa, COALESCE(s.u, 0) su,
                   COALESCE(b.a, 0) ba, COALESCE(b.u, 0) bu
            FROM s FULL OUTER JOIN b ON s.h = b.h)
      SELECT h, ROUND(sa, 2), ROUND(su / 1e6, 3), ROUND(ba, 2), ROUND(bu / 1e6, 3),
             ROUND(SUM(ba) OVER (ORDER BY h), 2) FROM c""").fetchall()
    assert len(got) == len(rows) > 0
    for h, sa, su, ba, bu, cum in rows:
        g = got[h]
        assert _close(g.rseth_supplied, sa, 1e-2) and _close(g.rseth_supply_usd_m, su, 1e-3)
        assert _close(g.eth_weth_borrowed, ba, 1e-2) and _close(g.eth_borrow_usd_m, bu, 1e-3)
        assert _close(g.cumul_eth_borrowed, cum, 1e-2)

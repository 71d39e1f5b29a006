"""Spark-vs-DuckDB comparison used by the tests and for manual checks.

Rows are compared order-insensitively after normalising values to plain
Python types; both sides must have the same column names.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(v) for v in r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(_norm(v) for v in r) for r in res.fetchall()]
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    out["match"] = s_sorted == d_sorted
    if not out["match"]:
        diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b]
        out["first_diffs"] = diffs[:3]
    return out

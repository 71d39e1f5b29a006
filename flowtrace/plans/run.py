"""Run registered queries and write each result table.

    python -m flowtrace.plans.run --sf-dir /root/testdata/sf0.01 --out /path/out [--csv] [names…]

Each result is written under ``<out>/<name>`` (Parquet, or CSV with a
header for dashboard tools). ``--out`` should be on storage every executor
can reach when running on a cluster.
"""

from __future__ import annotations

import argparse
import time

from ..session import get_session
from ..sources.tables import write_result
from .bound import QUERIES


def main(argv: list[str] | None = None) -> dict[str, float]:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--csv", action="store_true")
    ap.add_argument("--master", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    timings = {}
    for name in args.names or list(QUERIES):
        t0 = time.perf_counter()
        df = QUERIES[name](spark, args.sf_dir)
        write_result(df, f"{args.out}/{name}", fmt="csv" if args.csv else "parquet")
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]} s", flush=True)
    return timings


if __name__ == "__main__":
    main()

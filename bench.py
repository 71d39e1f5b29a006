"""Benchmark: run every query of the dashboards on one scale factor (the
lazy ones of plans/bound.py; the document operators have a check of their own).

Environment:
  BENCH_SF_DIR   parquet folder (default /root/testdata/sf0.1)
  BENCH_CPUS     local cores (default 8)
  BENCH_REPEATS  timed runs per query after one warm-up run (default 5)

Each run builds the query (which may execute checkpoint jobs) and executes
it fully through the ``noop`` sink. Per query the median of the timed runs
is reported; ``value`` is the sum of those medians. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowtrace.plans.bound import QUERIES  # noqa: E402
from flowtrace.session import get_session  # noqa: E402


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="flowtrace-bench")

    def run(fn) -> float:
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings = {}
    for name, fn in QUERIES.items():
        run(fn)  # warm-up: JIT, file listing, broadcast of small dimensions
        timings[name] = round(statistics.median(run(fn) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "sum of per-query median wall time (warm)",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": _sf(sf_dir),
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Write the final (adaptive) physical plan of every registered query.

    python tools/dump_plans.py [sf_dir] > PLANS.md

Each query's own QueryExecution is executed, so the printed plan is the one
AQE settled on (``isFinalPlan=true``): broadcast conversions, coalesced
partitions and skew splits included.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowtrace.plans.bound import QUERIES  # noqa: E402
from flowtrace.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    print(f"# Final physical plans ({sf_dir}, local[8], Spark {spark.version})\n")
    print("Generated by `tools/dump_plans.py`. Expression ids (`#123`) are stripped.\n")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()
        plan = qe.executedPlan().toString().split("+- == Initial Plan ==")[0]
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r", \[plan_id=\d+\]", "", plan)
        print(f"## {name}\n\n```\n{plan.rstrip()}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()

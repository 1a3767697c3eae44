"""Physical-plan audit of every registered job (sf0.01 by default).

For each job: number of shuffles (Exchange), broadcast exchanges, sort-merge
joins, windows without a partition key, nested-loop / cartesian joins, and
whether every Parquet scan projects a subset of columns. Streaming and ML
jobs (which run their plans eagerly) are skipped.
"""

from __future__ import annotations

import json
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from valuescope import catalog  # noqa: E402
from valuescope.session import build_session  # noqa: E402

SKIP_FAMILIES = {"ml", "streaming"}


def audit(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|"
                                    r"Exchange SinglePartition", plan)),
        "single_partition_exchanges": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "nested_loop_or_cartesian": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "python_udf": plan.count("BatchEvalPython") + plan.count("ArrowEvalPython"),
    }


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session()
    for name, e in catalog.load_all().items():
        if e.family in SKIP_FAMILIES:
            continue
        try:
            r = audit(e.fn(spark, sf_dir))
        except Exception as ex:  # report and continue
            r = {"error": repr(ex)[:200]}
        print(json.dumps({"name": name, **r}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

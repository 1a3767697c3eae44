"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each job's plan is executed fully with the no-op sink (no driver collect).
The first entry builds and writes the two marts (every later job reads them).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "user_mart", "late_payer_segments", "executive_kpis", "channel_dashboard", "cohort_weekly", "whale_tiers",
    "payer_tiers", "ttp_segments", "channel_whale_quality", "temporal_daily", "revenue_concentration",
    "pareto_curve", "gini", "spearman_features", "lift_curve", "ranking_scorecard", "auc_by_strategy",
    "seed_strategies", "topk_roi", "split_summary", "sample_stratified", "feature_contrast", "mart_windows",
    "window_retention", "stream_daily_kpis", "stream_checkpoints", "tfidf_topk", "churn_train_score",
    "window_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from valuescope import catalog
    from valuescope.plans.mart import user_mart
    from valuescope.plans.windows import window_mart
    from valuescope.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="valuescope-bench")
    reg = catalog.load_all()
    times: dict[str, float] = {}

    t0 = time.time()
    user_mart(spark, sf_dir)
    window_mart(spark, sf_dir)
    times["materialize_marts"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t = time.time()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_jobs_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

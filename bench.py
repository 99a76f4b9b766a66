"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up run, then a timed run that materialises the
whole result through the ``noop`` sink (no collect to the driver).  Prints one
JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "deterioration_features", "deterioration_target", "serve_deterioration", "timeline_audit", "user_split",
    "align_union", "group_median_fill", "priority_dedup", "describe", "corr_matrix", "null_fraction",
    "stratified_split", "impute_median", "mutual_info", "feat_burnout", "feat_stress", "serve_burnout",
    "threshold_sweep", "roc_auc", "source_audit", "auc_ovr", "contributors", "score_batch", "route_and_band",
    "crisis_flag", "norm_text", "json_defaults", "cap_sample", "external_validation", "smote", "isotonic_full", "score_requests", "typed_replies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskframe.session import get_session
    spark = get_session(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus) * 2))})
    from riskframe.plans import all_queries
    from riskframe.plans.registry import query_map
    all_queries.load()
    qs = query_map()
    keys = [k for k in HEADLINE if k in qs]
    if os.environ.get("BENCH_ALL"):
        keys = list(qs)
    times = {}
    for k in keys:
        for run in range(2):
            t0 = time.perf_counter()
            qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
        times[k] = round(dt, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_warm_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()

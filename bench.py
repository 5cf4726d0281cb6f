"""Headline-query timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8)
select the data and the local core count.  Each query is run once to warm
up and then timed (median of BENCH_REPEATS runs, default 1) with a full
``collect``-free action (``count`` over the result's rows via a no-op write).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "loan_book", "preprocess", "build_features", "rate_by_category", "rate_by_quantile_bin",
    "numeric_summary", "outlier_summary", "correlated_pairs_with_target", "dataframe_overview",
    "duplicate_summary", "metrics_table", "threshold_sweep", "model_selection_table",
    "roc_curve_points", "stratified_split", "median_impute_robust_scale", "frequency_encode",
    "separation_many", "profile_long", "categorical_profile", "clustering_metrics",
]


def main() -> None:
    from riskframe.session import get_spark
    from riskframe.plans.catalog import QUERIES
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = get_spark("riskframe-bench", cores=cpus, shuffle_partitions=int(cpus) * 2)
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

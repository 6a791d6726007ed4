"""Wall time of the headline queries: one untimed run, then the best of ``BENCH_RUNS`` (2 by default)."""

from __future__ import annotations

import json
import os
import sys
import time

from tabwright.plans import QUERIES
from tabwright.session import get_session

HEADLINE = [
    # profile
    "describe_numeric", "describe_all", "validate_near_constant", "column_profile",
    # missing data
    "check_missing", "missing_correlation", "impute_mean", "impute_median", "impute_grouped", "impute_interpolate_linear",
    "drop_duplicates",
    # outliers
    "outlier_iqr", "outlier_mad", "winsorize",
    # encodings and scaling
    "encode_one_hot", "encode_mean", "encode_binary", "scale_standard", "scale_robust", "quantile_transform",
    # analysis
    "box_stats", "crosstab_counts", "correlation_matrix", "time_resample", "cohort_retention",
    # neighbours
    "clf_knn", "outlier_lof",
    # models
    "chi2_scores", "reg_linear", "reg_decision_tree", "segment_kmeans",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            if attempt:
                best = elapsed if best is None else min(best, elapsed)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

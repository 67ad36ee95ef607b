"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from alertline.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "join_coverage",
    "clean_sentinels",
    "sparse_drop",
    "missing_profile_topn",
    "time_features",
    "describe_time",
    "rate_by_hour",
    "amount_histogram",
    "split_report",
    "positional_split",
    "quality_suite",
    "dup_keys",
    "det_rank",
    "staircase_rows",
    "staircase_blocks",
    "roc_auc",
    "avg_precision",
    "best_f1",
    "thr_metrics",
    "tied_curve_summary",
    "topk_table",
    "fpr_rows",
    "fpr_blocks",
    "tied_fpr_blocks",
    "operating_points",
    "ece_uniform",
    "reliability_quantile",
    "isotonic_probs",
    "platt_probs",
    "calibration_report",
    "median_impute",
    "ordinal_encode",
    "unseen_categories",
    "gbt_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("alertline-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["operating_points"](spark, folder).collect()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

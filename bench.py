"""Headline queries on local Spark; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs to the end (all rows, all columns) through the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "pairwise_comparison", "summarize_statistics", "anova_test", "anova_rows", "best_vs_full", "over_engineering_table",
    "box_stats", "rank_window", "cv_aggregate", "dedup_keep_last", "latest_artifact", "set_diff_columns",
    "profile_table", "leakage_check", "fill_median", "label_encode_wide", "split_holdout", "split_stratified", "kfold",
    "stratified_kfold", "scale_standard", "scale_robust", "select_k_best", "classification_metrics",
    "classification_report", "roc_auc", "roc_auc_continuous", "roc_auc_ovr", "regression_metrics", "vote_hard",
    "vote_soft_weighted", "extract_metrics", "extract_metrics_documents", "text_quality", "secret_scan", "token_count",
    "canonical_steps", "inspect_steps", "simulate_ablation", "linear_regression", "pca_variance", "ablate_linear_grid",
    "stream_runs_summary", "ablate_pipeline", "config_custom", "feature_ablation", "run_ablation_cv",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE

    from ablaspark import workload
    from ablaspark.session import local_session

    spark = local_session(cpus, "ablaspark-bench")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not a query
    table, seconds = workload.queries(), {}
    for name in wanted:
        start = time.perf_counter()
        table[name](spark, folder).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

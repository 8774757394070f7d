"""Sinks: result tables, task splits, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.comparing import compare_to_baseline
from ..operators.summaries import summarize_results

HISTORY_COLUMNS = ["timestamp", "dataset_name", "f1_score", "accuracy", "precision", "recall", "final_model",
                   "best_scaler", "best_feature_selector"]


def _save(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return path


def write_results(results: DataFrame, folder: str, prefix: str = "ablation", metric: str = "mean_accuracy",
                  fmt: str = "parquet") -> dict[str, str]:
    """Full results, their summary and, only if a ``full`` configuration exists, the comparison with it."""
    out = {"full": _save(results, f"{folder}/{prefix}_full_results", fmt),
           "summary": _save(summarize_results(results), f"{folder}/{prefix}_summary", fmt)}
    if not results.where("config_name = 'full'").limit(1).isEmpty():
        out["comparison"] = _save(compare_to_baseline(results, metric), f"{folder}/{prefix}_comparison", fmt)
    return out


def write_task_split(split: DataFrame, label: str, ids: list[str], folder: str, name: str = "split") -> dict[str, str]:
    """Training rows with the label, test rows without it, and the test labels under their ids."""
    train, test = (split.where(f"{name} = '{s}'").drop(name) for s in ("train", "test"))
    return {
        "train": _save(train, f"{folder}/train", "parquet"),
        "test": _save(test.drop(label), f"{folder}/test", "parquet"),
        "test_labels": _save(test.select(*ids, label), f"{folder}/test_labels", "parquet"),
    }


def append_history(rows: DataFrame, path: str) -> None:
    """Append run rows in the fixed column order; the table is created on first use."""
    rows.select(*HISTORY_COLUMNS).write.mode("append").parquet(path)

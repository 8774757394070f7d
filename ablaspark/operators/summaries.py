"""Group summaries over result tables (runs, comparisons, evaluations)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, ratio, real
from ..functions.tails import t_upper_ppf
from ..session import cut_lineage, small_side
from .ordering import exact_quantiles


def t_quantiles(df: DataFrame, degrees: str, tail: float, name: str = "__t") -> DataFrame:
    """Adds the t quantile of each row's degrees of freedom (null below 1), solved once for each distinct number.

    ``df`` is written to the checkpoint folder, so what it aggregates runs once. Groups of k distinct sizes need k * k / 2 rows at
    least, so the looked-up table stays far smaller than what was counted.
    """
    held = cut_lineage(df.withColumn("__nu", F.expr(f"cast({degrees} as bigint)")))
    solved = held.where("__nu > 0").select("__nu").distinct().withColumn(name, F.expr(t_upper_ppf(tail, "__nu")))
    return held.join(solved, "__nu", "left").drop("__nu")


def with_interval(moments: DataFrame, n: str, confidence: float = 0.95) -> DataFrame:
    """Add ci_lower and ci_upper to (mean, std, n) rows; NULL for n = 1 or zero spread.

    The quantile is looked up per distinct n; a stream, which can't be joined with itself, solves it in the row.
    """
    tail = (1.0 - confidence) / 2
    if moments.isStreaming:
        solved = moments.withColumn("__t", F.expr(f"case when {n} > 1 and std > 0 then {t_upper_ppf(tail, f'({n} - 1)')} end"))
    else:
        solved = t_quantiles(moments, f"{n} - 1", tail)
    half = f"case when {n} > 1 and std > 0 then __t * std / sqrt({n}) end"
    return solved.withColumn("__half", F.expr(half)).selectExpr(
        *[q(c) for c in moments.columns], "mean - __half as ci_lower", "mean + __half as ci_upper")


def confidence_interval(runs: DataFrame, value: str, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """(by..., mean, ci_lower, ci_upper)."""
    x = real(q(value))
    m = runs.groupBy(*by).agg(F.expr(f"avg({x})").alias("mean"), F.expr(f"stddev_samp({x})").alias("std"),
                              F.expr(f"count({x})").alias("n"))
    return with_interval(m, "n", confidence).select(*[q(b) for b in by], "mean", "ci_lower", "ci_upper")


def finish_statistics(moments: DataFrame, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Interval columns on top of (mean, std, min, max, n_runs); shared by batch and stream."""
    return with_interval(moments, "n_runs", confidence).select(
        *[q(b) for b in by], "mean", "std", "min", "max", "ci_lower", "ci_upper", "n_runs")


def summarize_statistics(runs: DataFrame, value: str, by: Sequence[str], confidence: float = 0.95,
                         ordered: bool = True) -> DataFrame:
    """mean, std (sample), min, max, interval and n per configuration, best mean first.

    ``ordered=False`` saves the sort where the table feeds another operator.
    """
    x = real(q(value))
    moments = runs.groupBy(*by).agg(
        F.expr(f"avg({x})").alias("mean"), F.expr(f"stddev_samp({x})").alias("std"),
        F.expr(f"min({x})").alias("min"), F.expr(f"max({x})").alias("max"), F.expr(f"count({x})").alias("n_runs"),
    )
    table = finish_statistics(moments, by, confidence)
    return table.orderBy(F.desc_nulls_last("mean"), *by) if ordered else table


def summarize_results(results: DataFrame, by: Sequence[str] = ("config_name",),
                      metrics: Sequence[str] | None = None) -> DataFrame:
    """<metric>_mean/_std/_min/_max per group over successful rows, run time and count.

    By default every ``mean_*`` column is a metric.
    """
    ok = results.where("status = 'success'")
    names = [m for m in (metrics or [c for c in ok.columns if c.startswith("mean_")]) if m in ok.columns]
    aggs = []
    for m in names:
        base = m.replace("mean_", "")
        aggs += [F.expr(f"{fn}({real(q(m))})").alias(f"{base}_{p}")
                 for p, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    if "time_sec" in ok.columns:
        aggs += [F.expr("avg(time_sec)").alias("time_mean"), F.expr("stddev_samp(time_sec)").alias("time_std")]
    return ok.groupBy(*by).agg(*aggs, F.expr("count(1)").alias("n_experiments"))


def summary_all_datasets(runs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """mean, population std and n per dataset and configuration."""
    return runs.groupBy(*by).agg(
        F.expr(f"avg({q(value)})").alias("mean_accuracy"), F.expr(f"stddev_pop({q(value)})").alias("std_accuracy"),
        F.expr(f"count({q(value)})").alias("n_runs"))


def pivot_metric(df: DataFrame, rows: str, columns: str, value: str, names: Sequence | None = None) -> DataFrame:
    """Mean matrix; a missing cell is NULL. Name the columns to save the extra distinct job."""
    return df.groupBy(q(rows)).pivot(columns, list(names) if names else None).agg(F.expr(f"avg({q(value)})"))


def model_averages(df: DataFrame, model: str = "model", accuracy: str = "accuracy_mean",
                   seconds: str = "generation_time") -> DataFrame:
    return df.groupBy(q(model)).agg(
        F.expr(f"avg({q(accuracy)})").alias("accuracy_mean"),
        F.expr(f"stddev_samp({q(accuracy)})").alias("accuracy_std"),
        F.expr(f"count({q(accuracy)})").alias("n"), F.expr(f"avg({q(seconds)})").alias("time_mean"),
        F.expr(f"min({q(seconds)})").alias("time_min"), F.expr(f"max({q(seconds)})").alias("time_max"))


def method_summary(runs: DataFrame, by: Sequence[str], means: Sequence[str], shares: Sequence[str],
                   first: str, order: str, digits: int = 4) -> DataFrame:
    """Rounded means, shares of true flags, and the first value in row order, over successes."""
    ok = runs.where("status = 'success'")
    return ok.groupBy(*by).agg(
        *[F.expr(f"round(avg({q(m)}), {digits})").alias(m) for m in means],
        *[F.expr(f"round(avg(cast({q(s)} as int)), {digits})").alias(s) for s in shares],
        F.expr(f"min_by({q(first)}, case when {q(first)} is not null then {order} end)").alias(first))


def reduce_comparison(records: DataFrame, numbers: Sequence[str], order: str,
                      by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Mean of the present numbers, first non-empty model and step list (joined by '|')."""
    ok = records.where("coalesce(success, true)")
    return ok.groupBy(*by).agg(
        *[F.expr(f"avg({q(n)})").alias(n) for n in numbers],
        F.expr(f"min_by(model_used, {order}) filter (where model_used != '')").alias("model_used"),
        F.expr(f"coalesce(array_join(min_by(pipeline_steps, {order}) filter (where size(pipeline_steps) > 0), '|'), '')")
        .alias("pipeline_steps"))


def metric_by_task_type(evaluations: DataFrame) -> DataFrame:
    """(task, artifact_type, mean_metric, count)."""
    missing = {"task", "artifact_type", "metric_value"} - set(evaluations.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return evaluations.groupBy("task", "artifact_type").agg(
        F.expr("avg(metric_value)").alias("mean_metric"), F.expr("count(metric_value)").alias("count"))


def nest_by_task(grouped: DataFrame) -> DataFrame:
    """(task, metrics): map artifact_type -> (mean, count); a task has few artifact types."""
    return grouped.groupBy("task").agg(F.expr(
        "map_from_entries(collect_list(struct(artifact_type, struct(mean_metric as mean, `count`))))").alias("metrics"))


def complexity_split(df: DataFrame) -> DataFrame:
    """Counts, shares and mean accuracy of complex and simple models; no simple model means 0."""
    c, s = "complexity = 'complex'", "complexity = 'simple'"
    sums = df.agg(
        F.expr(f"count_if({c})").alias("complex_n"), F.expr(f"count_if({s})").alias("simple_n"),
        F.expr("count(1)").alias("n"), F.expr(f"avg(case when {c} then accuracy_mean end)").alias("complex_accuracy"),
        F.expr(f"coalesce(avg(case when {s} then accuracy_mean end), 0.0D)").alias("simple_accuracy"))
    return sums.selectExpr(
        "complex_n", "simple_n", f"{ratio('100 * complex_n', 'n')} as complex_pct",
        f"{ratio('100 * simple_n', 'n')} as simple_pct", "complex_accuracy", "simple_accuracy",
        "complex_accuracy - simple_accuracy as difference")


def effect_distribution(effects: DataFrame, effect: str = "cohens_d", delta: str = "delta") -> DataFrame:
    """count, mean and median effect, mean score gain over experiments."""
    effects = cut_lineage(effects.select(effect, delta))
    median = exact_quantiles(effects, q(effect), [0.5]).first()
    mid = "cast(null as double)" if median is None else f"{median['q']!r}D"
    return effects.agg(
        F.expr(f"count({real(q(effect))})").alias("n"), F.expr(f"avg({real(q(effect))})").alias("mean_d"),
        F.expr(mid).alias("median_d"), F.expr(f"avg({real(q(delta))})").alias("mean_delta"))


def stage_status(artifacts: DataFrame, task: str = "task", kind: str = "artifact_type") -> DataFrame:
    """Which stages each task reached, and the resulting status text."""
    flags = artifacts.groupBy(q(task)).agg(*[
        F.expr(f"bool_or({q(kind)} = '{s}')").alias(f"has_{s}") for s in ("initialization", "refinement", "ensemble")])
    return flags.selectExpr(
        "*",
        "case when has_initialization and has_refinement and has_ensemble then 'Complete'"
        " when has_initialization and has_refinement then 'Partial (no ensemble)'"
        " when has_initialization then 'Initialization only' else 'No artifacts' end as status")


def box_stats(runs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The numbers of a box plot: quartiles and the farthest points within 1.5 IQR."""
    quart = exact_quantiles(runs, value, [0.25, 0.5, 0.75], by).groupBy(*by).pivot("p", [0.25, 0.5, 0.75]).agg(
        F.expr("first(q)")).withColumnsRenamed({"0.25": "q1", "0.5": "median", "0.75": "q3"})
    fences = small_side(cut_lineage(quart.selectExpr(*[f"{q(b)} as __{b}" for b in by], "q1", "median", "q3")))
    same = " and ".join(f"{q(b)} <=> __{b}" for b in by)
    rows = runs.join(fences, F.expr(same))
    inside = f"({value}) between q1 - 1.5D * (q3 - q1) and q3 + 1.5D * (q3 - q1)"
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.expr(f"min(case when {inside} then {value} end)").alias("whisker_low"),
        F.expr(f"max(case when {inside} then {value} end)").alias("whisker_high"),
        F.expr(f"count(case when not ({inside}) then 1 end)").alias("n_outliers"))



"""Best rows, baselines and report tables. Arg-max is an aggregate, never a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, ratio, real
from .hypothesis import effect_label, p_stars, pooled_d, with_d_interval


def best_per_group(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The whole row with the best score per group; ties go to the smallest ``tie`` columns.

    ``max_by`` keeps one row per group and combines map-side, so a huge group is cheap.
    """
    x = real(q(score)) if dict(df.dtypes)[score] in ("double", "float") else q(score)
    rest = [c for c in df.columns if c not in by]
    order = f"struct({'-' if largest else ''}{x}, {', '.join(q(t) for t in tie)})"
    kept = df.where(f"{x} is not null").groupBy(*by).agg(
        F.expr(f"min_by(struct({', '.join(q(c) for c in rest)}), {order})").alias("__row"))
    return kept.selectExpr(*[q(b) for b in by], "__row.*")


def dedup_keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last under ``order`` (which must be total)."""
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.expr(
        f"max_by(struct({', '.join(q(c) for c in rest)}), struct({', '.join(order)}))").alias("__row"))
    return kept.selectExpr(*[q(k) for k in key], "__row.*").select(*[q(c) for c in df.columns])


def best_fastest_overall(df: DataFrame, name: str, accuracy: str, seconds: str, comments: str) -> DataFrame:
    """One row: most accurate, fastest and best documented entry with their figures."""
    return df.agg(
        F.expr(f"min_by({q(name)}, struct(-{q(accuracy)}, {q(name)}))").alias("best"),
        F.expr(f"max({q(accuracy)})").alias("best_accuracy"),
        F.expr(f"min_by({q(name)}, struct({q(seconds)}, {q(name)}))").alias("fastest"),
        F.expr(f"min({q(seconds)})").alias("fastest_time"),
        F.expr(f"min_by({q(name)}, struct(-{q(comments)}, {q(name)}))").alias("best_documented"),
        F.expr(f"max({q(comments)})").alias("best_comments"))


def adopt_recommendation(df: DataFrame, name: str = "model", accuracy: str = "accuracy_mean",
                         seconds: str = "generation_time") -> DataFrame:
    """Range under 1 point: fastest; over 2 points above the worst: best; else balanced."""
    sums = df.agg(
        F.expr(f"max({q(accuracy)}) - min({q(accuracy)})").alias("accuracy_range"),
        F.expr(f"min_by({q(name)}, struct(-{q(accuracy)}, {q(name)}))").alias("best"),
        F.expr(f"min_by({q(name)}, struct({q(seconds)}, {q(name)}))").alias("fastest"))
    return sums.selectExpr(
        "accuracy_range",
        "case when accuracy_range < 0.01D then 'fastest' when accuracy_range > 0.02D then 'best' else 'balanced' end as advice",
        "case when accuracy_range < 0.01D then fastest when accuracy_range > 0.02D then best end as model")


def latest_artifact(files: DataFrame, by: str = "experiment", path: str = "path", n_runs: str = "full_n_runs",
                    expected: str = "expected_n_runs") -> DataFrame:
    """Newest file per experiment, first among those whose full row has the expected run count.

    The stamp YYYYMMDD_HHMMSS comes from the file name; without one it counts as oldest.
    """
    stamped = files.withColumn("stamp", F.expr(
        f"coalesce(nullif(regexp_extract({q(path)}, '_([0-9]{{8}}_[0-9]{{6}})[.]csv$', 1), ''), '00000000_000000')"))
    usable = f"coalesce({q(n_runs)} = {q(expected)}, false)"
    return stamped.groupBy(q(by)).agg(
        F.expr(f"max_by({q(path)}, struct({usable}, stamp, {q(path)}))").alias("path"),
        F.expr(f"max_by(stamp, struct({usable}, stamp, {q(path)}))").alias("stamp"),
        F.expr(f"bool_or({usable})").alias("usable"))


def compare_to_baseline(results: DataFrame, metric: str, baseline: str = "full", by: Sequence[str] = (),
                        config: str = "config_name") -> DataFrame:
    """mean, std, count per configuration, and its change against the baseline configuration.

    Over successful rows. A missing baseline is an error (checked for the ungrouped form;
    grouped, an experiment without one yields no rows).
    """
    ok = results.where("status = 'success'") if "status" in results.columns else results
    m = ok.groupBy(*by, F.col(q(config)).alias("configuration")).agg(
        F.expr(f"avg({real(q(metric))})").alias("mean"), F.expr(f"stddev_samp({real(q(metric))})").alias("std"),
        F.expr(f"count({real(q(metric))})").alias("count"))
    base = m.where(f"configuration = '{baseline}'").selectExpr(*[q(b) for b in by], "mean as baseline_value")
    if by:
        joined = m.join(base, list(by))
    else:
        row = base.first()
        if row is None:
            raise ValueError(f"baseline configuration '{baseline}' not found")
        joined = m.withColumn("baseline_value", F.lit(row["baseline_value"]))
    return joined.selectExpr(
        *[q(b) for b in by], "configuration", "mean", "std", "count", "baseline_value",
        "mean - baseline_value as delta", f"{ratio('(mean - baseline_value) * 100', 'baseline_value')} as delta_pct",
    ).orderBy(*by, F.desc_nulls_last("delta_pct"), "configuration")


def impact_table(scores: DataFrame, metric: str, baseline: str = "baseline", by: Sequence[str] = ()) -> DataFrame:
    """Improvement of each configuration over the baseline, smallest first, baseline left out."""
    base = scores.where(f"configuration = '{baseline}'").selectExpr(*[q(b) for b in by], f"{q(metric)} as __base")
    joined = scores.join(base, list(by)) if by else scores.withColumn("__base", F.lit(base.first()[0]))
    return joined.where(f"configuration != '{baseline}'").selectExpr(
        *[q(b) for b in by], "configuration", q(metric), f"{q(metric)} - __base as improvement",
        f"{ratio(f'({q(metric)} - __base) * 100', '__base')} as improvement_pct",
    ).orderBy(*by, "improvement", "configuration")


def best_vs_full(summary: DataFrame, pairs: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Best configuration other than full and baseline, tested against full, per experiment.

    ``summary`` has mean, std, n_runs per configuration; ``pairs`` is the pairwise table.
    The sign of t and d is turned to best-minus-full. A best configuration without its
    pairwise row is an error.
    """
    best = best_per_group(
        summary.where("configuration not in ('full', 'baseline')"), by, "mean", ["configuration"]
    ).selectExpr(*[q(b) for b in by], "configuration as best_config", "mean as best_score", "std as best_std")
    full = summary.where("configuration = 'full'").selectExpr(
        *[q(b) for b in by], "mean as full_score", "std as full_std", "n_runs as n")
    turned = pairs.where("config_a = 'full' or config_b = 'full'").selectExpr(
        *[q(b) for b in by], "if(config_a = 'full', config_b, config_a) as best_config",
        "if(config_a = 'full', -t_statistic, t_statistic) as t_statistic", "p_value",
        "if(config_a = 'full', -cohen_d, cohen_d) as cohens_d", "bonferroni_significant", "corrected_alpha",
        "true as __paired")
    missing = "cast(raise_error(concat('no pairwise row of full and ', best_config)) as double)"
    row = best.join(full, list(by)).join(turned, [*by, "best_config"], "left").withColumn(
        "t_statistic", F.expr(f"if(__paired is null, {missing}, t_statistic)"))
    return with_d_interval(row, "cohens_d", "n", "n", alpha).selectExpr(
        *[q(b) for b in by], "best_config", "best_score", "best_std", "full_score", "full_std",
        "best_score - full_score as delta", "t_statistic", "p_value", f"{p_stars('p_value')} as p_interpret",
        "cohens_d", "d_ci_lower", "d_ci_upper",
        f"coalesce({effect_label('cohens_d', True)}, '') as d_interpret", "n", "bonferroni_significant",
        "corrected_alpha")


def over_engineering_table(summary: DataFrame, by: Sequence[str], n: int = 20, ordered: bool = True) -> DataFrame:
    """Best of minimal and no_feature_engineering against full, effect from the summary rows.

    ``n`` is the run count of both sides; experiments lacking a side drop out.
    """
    keep = summary.where("configuration in ('minimal', 'no_feature_engineering')")
    best = best_per_group(keep, by, "mean", ["configuration"]).selectExpr(
        *[q(b) for b in by], "configuration as best_config", "mean as best_score", "std as best_std",
        "ci_lower as best_ci_lower", "ci_upper as best_ci_upper")
    full = summary.where("configuration = 'full'").selectExpr(
        *[q(b) for b in by], "mean as full_score", "std as full_std")
    d = pooled_d("best_score", "best_std", str(n), "full_score", "full_std", str(n))
    table = best.join(full, list(by)).withColumn("cohen_d", F.expr(d)).selectExpr(
        *[q(b) for b in by], "best_config", "best_score", "best_std", "best_ci_lower", "best_ci_upper",
        "full_score", "full_std", "best_score - full_score as delta", "cohen_d",
        f"{effect_label('cohen_d', True)} as effect_size",
    )
    return table.orderBy(F.desc_nulls_last("cohen_d"), *by) if ordered else table


def forest_table(effects: DataFrame, by: Sequence[str]) -> DataFrame:
    """Delta with half-width (hi - lo) / 2, ascending by delta."""
    return effects.selectExpr(
        *[q(b) for b in by], "best_config", "delta", "(best_ci_upper - best_ci_lower) / 2 as half_width",
        "cohen_d", "effect_size").orderBy("delta", *by)


def global_report(summary: DataFrame, manifest: DataFrame, by: str = "experiment") -> DataFrame:
    """Best, baseline and full score per experiment with gains; best may be the baseline."""
    scores = summary.groupBy(q(by)).agg(
        F.expr("min_by(configuration, struct(-mean, configuration)) filter (where mean is not null)").alias("best_config"),
        F.expr("max(mean)").alias("best_score"),
        F.expr("min_by(std, struct(-mean, configuration)) filter (where mean is not null)").alias("best_std"),
        F.expr("max(case when configuration = 'baseline' then mean end)").alias("baseline_score"),
        F.expr("max(case when configuration = 'full' then mean end)").alias("full_score"))
    return manifest.join(scores, by).selectExpr(
        q(by), "dataset", "task_type", "best_config", "best_score", "best_std", "baseline_score", "full_score",
        "best_score - baseline_score as gain_over_baseline", "best_score - full_score as gain_over_full")

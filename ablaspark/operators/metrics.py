"""Quality metrics as aggregates. Rows are touched once; the rest runs on counts.

Every function takes ``by``: grouping columns (for example configuration, run, fold),
so one job scores any number of models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, ratio, ratio0, real
from ..session import cut_lineage, small_side
from .ordering import null_safe_join, ordered_rank, prefix_sums


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, prediction, n): the only pass over the predictions."""
    return df.groupBy(
        *[F.col(q(b)) for b in by], F.col(q(label)).alias("label"), F.col(q(prediction)).alias("prediction")
    ).agg(F.expr("count(1)").alias("n"))


def class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class, tp, support, predicted) over the union of labels and predictions."""
    sides = counts.selectExpr(
        *[q(b) for b in by],
        "inline(array("
        "named_struct('class', label, 'tp', if(label = prediction, n, 0L), 'support', n, 'predicted', 0L),"
        "named_struct('class', prediction, 'tp', 0L, 'support', 0L, 'predicted', n)))",
    )
    return sides.groupBy(*by, "class").agg(
        *[F.expr(f"cast(sum({c}) as bigint)").alias(c) for c in ("tp", "support", "predicted")])


def per_class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class, precision, recall, f1_score, support); undefined ratios are 0."""
    return class_counts(counts, by).selectExpr(
        *[q(b) for b in by], "class", f"{ratio0('tp', 'predicted')} as precision",
        f"{ratio0('tp', 'support')} as recall", f"{ratio0('2 * tp', 'predicted + support')} as f1_score",
        "support", "tp", "predicted",
    )


def classification_metrics(df: DataFrame, label: str, prediction: str, average: str = "weighted",
                           by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1_score with weighted (by support) or macro averages."""
    if average not in ("weighted", "macro"):
        raise ValueError("average must be weighted or macro")
    classes = per_class_metrics(confusion_counts(df, label, prediction, by), by)
    weight = "support" if average == "weighted" else "1"

    def mean(c: str) -> str:
        return ratio(f"sum({c} * {weight})", f"sum({weight})")

    return classes.groupBy(*by).agg(
        F.expr(ratio("sum(tp)", "sum(support)")).alias("accuracy"),
        *[F.expr(mean(c)).alias(c) for c in ("precision", "recall", "f1_score")],
    )


def macro_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return classification_metrics(df, label, prediction, "macro", by)


def binary_metrics(df: DataFrame, label: str, prediction: str, positive: str = "1",
                   by: Sequence[str] = ()) -> DataFrame:
    """f1_score, accuracy, precision, recall of the positive class (``positive`` is SQL)."""
    y, p = f"({q(label)} = {positive})", f"({q(prediction)} = {positive})"
    sums = df.groupBy(*by).agg(
        F.expr(f"count_if({y} and {p})").alias("tp"), F.expr(f"count_if(not {y} and {p})").alias("fp"),
        F.expr(f"count_if({y} and not {p})").alias("fn"),
        F.expr(f"count_if({q(label)} = {q(prediction)})").alias("hit"), F.expr("count(1)").alias("n"),
    )
    return sums.selectExpr(
        *[q(b) for b in by], f"{ratio0('2 * tp', '2 * tp + fp + fn')} as f1_score",
        f"{ratio('hit', 'n')} as accuracy", f"{ratio0('tp', 'tp + fp')} as precision",
        f"{ratio0('tp', 'tp + fn')} as recall",
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Wide matrix: one row per true label, one ``p_<class>`` column per predicted class."""
    counts = confusion_counts(df, label, prediction, by)
    pivot = counts.groupBy(*by, "label").pivot("prediction", list(classes) if classes else None)
    wide = pivot.agg(F.expr("cast(sum(n) as bigint)")).na.fill(0)
    fixed = [*by, "label"]
    return wide.select(*fixed, *[F.col(q(c)).alias(f"p_{c}") for c in wide.columns if c not in fixed])


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class rows followed by accuracy, macro avg and weighted avg rows."""
    classes = per_class_metrics(confusion_counts(df, label, prediction))
    body = classes.selectExpr("cast(class as string) as name", "precision", "recall", "f1_score", "support")
    sums = classes.agg(
        F.expr("cast(sum(support) as bigint)").alias("n"),
        F.expr(ratio("sum(tp)", "sum(support)")).alias("acc"),
        *[F.expr(f"avg({c})").alias(f"m_{c}") for c in ("precision", "recall", "f1_score")],
        *[F.expr(ratio(f"sum({c} * support)", "sum(support)")).alias(f"w_{c}")
          for c in ("precision", "recall", "f1_score")],
    )
    tail = sums.selectExpr(
        "inline(array("
        "named_struct('name', 'accuracy', 'precision', acc, 'recall', acc, 'f1_score', acc, 'support', n),"
        "named_struct('name', 'macro avg', 'precision', m_precision, 'recall', m_recall, 'f1_score', m_f1_score, 'support', n),"
        "named_struct('name', 'weighted avg', 'precision', w_precision, 'recall', w_recall, 'f1_score', w_f1_score, 'support', n)))"
    )
    return body.unionByName(tail)


def _auc_parts(df: DataFrame, hit: str, score: str, by: Sequence[str]) -> DataFrame:
    """(by..., roc_auc, n_pos) from a boolean ``hit`` and a score, both SQL."""
    scores = (
        df.selectExpr(*[q(b) for b in by], f"cast({score} as double) as s", f"{hit} as y")
        .where("s is not null and not isnan(s) and y is not null").groupBy(*by, "s")
        .agg(F.expr("count_if(y)").alias("pos"), F.expr("count_if(not y)").alias("neg"))
    )
    # Several steps below read the score table; the rows behind it are aggregated once.
    ordered = prefix_sums(cut_lineage(scores), ["s"], ["neg"], by)
    won = "sum(cast(pos as double) * (before_neg + neg / 2.0D))"
    area = ratio(won, "sum(cast(pos as double)) * sum(cast(neg as double))")
    return ordered.groupBy(*by).agg(F.expr(area).alias("roc_auc"), F.expr("cast(sum(pos) as bigint)").alias("n_pos"))


def roc_auc(df: DataFrame, label: str, score: str, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    """(by..., roc_auc): area under the ROC curve; tied scores get the mid-rank.

    Rows collapse to one per distinct score first; the running count of negatives then
    comes from bucketed prefix sums, so no task ever sorts all scores. NULL where only
    one class is present.
    """
    return _auc_parts(df, f"({q(label)} = {positive})", q(score), by).drop("n_pos")


def roc_auc_ovr(df: DataFrame, label: str, scores: dict, average: str = "weighted") -> DataFrame:
    """One-vs-rest AUC: ``scores`` maps each class value to its score column.

    One exploded pass feeds all classes; weighted means weighted by class prevalence. A class
    without both sides makes the average undefined.
    """
    typed = dict(df.dtypes)[label]

    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else repr(v)

    pairs = ", ".join(
        f"named_struct('cls', cast({lit(c)} as {typed}), 's', cast({q(s)} as double))" for c, s in scores.items())
    long = df.selectExpr(f"{q(label)} as y", f"inline(array({pairs}))").selectExpr("cls", "s", "y = cls as hit")
    weight = "n_pos" if average == "weighted" else "1"
    mean = f"case when count_if(roc_auc is null) = 0 then {ratio(f'sum(roc_auc * {weight})', f'sum({weight})')} end"
    return _auc_parts(long, "hit", "s", ["cls"]).agg(F.expr(mean).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2_score; r2 is 0 when the target is constant."""
    y, e = f"cast({q(label)} as double)", f"(cast({q(label)} as double) - cast({q(prediction)} as double))"
    sums = df.groupBy(*by).agg(
        F.expr(f"avg({e} * {e})").alias("mse"), F.expr(f"avg(abs({e}))").alias("mae"),
        F.expr(f"var_pop({y})").alias("var"),
    )
    return sums.selectExpr(
        *[q(b) for b in by], "mse", "sqrt(mse) as rmse", "mae",
        "case when mse is null then null when var = 0 then 0.0D else 1 - mse / var end as r2_score",
    )


def rank_metrics(metrics: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Position of each configuration by metric, with best-minus-worst (absolute and %).

    A missing metric sorts as 0 and stays missing. ``metrics`` holds one row per
    configuration; the ranks come from range partitions, so no experiment is one task.
    """
    rows = metrics.withColumn("__key", F.expr(f"coalesce({real(q(metric))}, 0.0D)"))
    ranked = cut_lineage(ordered_rank(rows, ["-__key", "configuration"], "rank", by))
    spread = ranked.groupBy(*by).agg(F.max("__key").alias("__hi"), F.min("__key").alias("__lo"))
    ranked = null_safe_join(ranked, small_side(spread), by) if by else ranked.join(F.broadcast(spread))
    return ranked.selectExpr(
        *[q(b) for b in by], "configuration", f"{real(q(metric))} as {q(metric)}", "rank",
        "__hi - __lo as best_vs_worst",
        "case when __lo = 0 then 0.0D else (__hi - __lo) / __lo * 100 end as best_vs_worst_pct",
    )


def cv_aggregate(folds: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Fold rows to mean_/std_/min_/max_ per metric; std is population; neg_ scores flip sign."""
    aggs = [F.expr("count(1)").alias("n_folds")]
    for m in metrics:
        name, x = (m[4:], f"-{q(m)}") if m.startswith("neg_") else (m, q(m))
        aggs += [F.expr(f"{fn}({x})").alias(f"{p}_{name}")
                 for p, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
    if "time_sec" in folds.columns:
        aggs += [F.expr("sum(time_sec)").alias("time_sec"), F.expr("avg(time_sec)").alias("time_per_fold_sec")]
    return folds.groupBy(*by).agg(*aggs)


def repeat_cv(folds: DataFrame, score: str, by: Sequence[str], run: str = "run") -> DataFrame:
    """Mean of fold means over runs: score_mean, score_std (population), n_runs; none gives 0,0,0.

    Groups come from all rows; a run counts only if every fold has a score.
    """
    runs = folds.groupBy(*by, run).agg(
        F.expr(f"case when count({real(q(score))}) = count(1) then avg({q(score)}) end").alias("s"))
    return runs.groupBy(*by).agg(
        F.expr("coalesce(avg(s), 0.0D)").alias("score_mean"),
        F.expr("coalesce(stddev_pop(s), 0.0D)").alias("score_std"), F.expr("count(s)").alias("n_runs"),
    )

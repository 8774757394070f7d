"""Ablation runs: configurations x seeds (x folds), one long run-result table.

The driver only loops over fits and keeps scalars. Each split is a projection on the
table, persisted once per seed and shared by every configuration; folds likewise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.configs import TOGGLES, AblationConfig, standard_configs
from ..operators.features import dummy_class, predict_constant
from ..operators.splitting import kfold, split_holdout, split_stratified, stratified_kfold
from ..operators.stages import stage_key
from ..session import concurrently
from .pipelines import Builder, build

RUN_SCHEMA = "configuration string, cfg_ord int, run int, random_state int, metric string, value double"


def score(predictions: DataFrame, task: str, label: str = "label", average: str = "weighted",
          auc: bool = True) -> dict[str, float]:
    """All metrics of one prediction set. ROC AUC is None without probabilities or with a single class.

    More than two classes give the one-vs-rest AUC, weighted by class; labels number the probabilities.
    The model runs once: only label, prediction and probabilities are kept for the metrics.
    """
    soft = auc and "probability" in predictions.columns
    kept = predictions.select(
        label, "prediction", *([vector_to_array("probability").alias("__p")] if soft else [])
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if task == "regression":
            return metrics.regression_metrics(kept, label, "prediction").first().asDict()
        out = metrics.classification_metrics(kept, label, "prediction", average).first().asDict()
        if auc:
            out["roc_auc"] = _auc(kept, label) if soft else None
        return out
    finally:
        kept.unpersist()


def _auc(kept: DataFrame, label: str) -> float | None:
    size = kept.agg(F.max(F.size("__p"))).first()[0] or 0
    if size < 2:
        return None
    spread = kept.select(label, *[F.get("__p", F.lit(k)).alias(f"__s{k}") for k in range(size)])
    present = [r[0] for r in kept.select(label).distinct().limit(size + 1).collect()]
    if len(present) < 2:
        return None
    if size == 2:
        return metrics.roc_auc(spread, label, "__s1", repr(max(present))).first()["roc_auc"]
    kinds = [type(present[0])(k) for k in range(size)]
    return metrics.roc_auc_ovr(spread, label, {c: f"__s{k}" for k, c in enumerate(kinds) if c in present}).first()["roc_auc"]


def baseline_predictions(train: DataFrame, test: DataFrame, task: str, label: str) -> DataFrame:
    if task == "regression":
        return predict_constant(test, train.agg(F.avg(label).alias("prediction")))
    classes = train.agg(F.max(F.col(label).cast("int"))).first()[0]
    even = array_to_vector(F.array(*[F.lit(1.0)] * (max(1, classes or 0) + 1)))  # ranks nothing: AUC 0.5
    return predict_constant(test, dummy_class(train, label)).withColumn("probability", even)


#: What a broken configuration raises.
CONFIG_ERRORS = (ValueError, TypeError, LookupError, AttributeError, ArithmeticError, NotImplementedError,
                 IllegalArgumentException, AnalysisException)


def broken_configuration(error: Exception) -> bool:
    """Whether the configuration is at fault; lost executors, missing folders or files end a study."""
    where = (error.getCondition() or "") if isinstance(error, AnalysisException) else ""
    return isinstance(error, CONFIG_ERRORS) and "PATH" not in where and "FILE" not in where


def fit_together(plans: Mapping[str, Sequence], train: DataFrame, test: DataFrame, parallelism: int = 4
                 ) -> dict[str, tuple[DataFrame | Exception, float]]:
    """Fit many pipelines (name -> stages) on one train set: (predictions, or what broke it; seconds of its fits).

    The pipelines form a prefix tree: stages that are equal so far (see ``stage_key``) are fitted once, and what comes below a
    common stage runs concurrently. A train set that several branches continue from is kept while they do. Each
    pipeline is charged the fits of its whole path, as if it had run alone.
    """
    done: dict[str, tuple[DataFrame | Exception, float]] = {}

    def go_on(group: list[str], depth: int, train: DataFrame, test: DataFrame, seconds: float) -> None:
        branches: dict[tuple, list[str]] = {}
        for name in group:
            if len(plans[name]) == depth:
                done[name] = (test, seconds)
            else:
                branches.setdefault(stage_key(plans[name][depth]), []).append(name)
        kept = train.persist(StorageLevel.MEMORY_AND_DISK) if len(branches) > 1 and depth else None
        try:
            concurrently([lambda b=b: branch(b, depth, train, test, seconds) for b in branches.values()], parallelism)
        finally:
            if kept is not None:
                kept.unpersist()

    def branch(group: list[str], depth: int, train: DataFrame, test: DataFrame, seconds: float) -> None:
        try:
            stage = plans[group[0]][depth]
            start = time.perf_counter()
            model = stage.fit(train) if hasattr(stage, "fit") else stage
            seconds += time.perf_counter() - start
            below = model.transform(train) if any(len(plans[n]) > depth + 1 for n in group) else train
            after = model.transform(test)
        except Exception as error:
            if not broken_configuration(error):
                raise
            done.update({n: (error, seconds) for n in group})
            return
        go_on(group, depth + 1, below, after, seconds)

    go_on(list(plans), 0, train, test, 0.0)
    return done


def _outcomes(builder, plan: Sequence[AblationConfig | None], train: DataFrame, test: DataFrame, task: str, label: str,
              scores: Callable[[DataFrame], dict]) -> dict[str, tuple[dict | Exception, float]]:
    """Scores (or the error) and fit seconds of the baseline (None) and of every configuration."""
    stages_of, out = {}, {}
    for config in plan:
        name = config.name if config else "baseline"
        try:
            if config is not None:
                stages_of[name] = build(builder, config).getStages()
        except Exception as error:
            if not broken_configuration(error):
                raise
            out[name] = (error, 0.0)
    fitted = fit_together(stages_of, train, test)
    if any(c is None for c in plan):
        start = time.perf_counter()
        fitted["baseline"] = (baseline_predictions(train, test, task, label), time.perf_counter() - start)

    def judge(name: str, predictions: DataFrame | Exception, seconds: float) -> None:
        if not isinstance(predictions, Exception):
            try:
                predictions = scores(predictions)
            except Exception as error:
                if not broken_configuration(error):
                    raise
                predictions = error
        out[name] = (predictions, seconds)

    concurrently([lambda n=n, p=p, s=s: judge(n, p, s) for n, (p, s) in fitted.items()])
    return out


def run_holdout(df: DataFrame, ids: Sequence[str], label: str, builder: str | Builder,
                configs: Sequence[AblationConfig] | None = None, n_runs: int = 5, seed: int = 42,
                task: str = "classification", test_size: float = 0.2, baseline: bool = True) -> DataFrame:
    """Runs table in long form. Run i splits with seed + i; a failing fit leaves no row."""
    spark = df.sparkSession
    plan: list[AblationConfig | None] = ([None] if baseline else []) + list(configs or standard_configs())
    own = df.storageLevel == StorageLevel.NONE
    if own:
        df.persist(StorageLevel.MEMORY_AND_DISK)  # its features are computed once, not once a run
    try:
        return spark.createDataFrame(_runs_of(df, ids, label, builder, plan, n_runs, seed, task, test_size), RUN_SCHEMA)
    finally:
        if own:
            df.unpersist()


def _runs_of(df, ids, label, builder, plan, n_runs, seed, task, test_size) -> list[tuple]:
    rows = []
    for i in range(n_runs):
        split = (split_holdout(df, ids, test_size, seed + i) if task == "regression"
                 else split_stratified(df, ids, label, test_size, seed + i)).persist(StorageLevel.MEMORY_AND_DISK)
        train, test = (split.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
        found = _outcomes(builder, plan, train, test, task, label, lambda p: score(p, task, label))
        for order, config in enumerate(plan):
            name = config.name if config else "baseline"
            values, seconds = found[name]
            if isinstance(values, Exception):  # a broken configuration must not end the study
                print(f"skipped {name}, run {i + 1}: {type(values).__name__}")
                continue
            values = values | {"train_time": seconds}
            rows += [(name, order, i + 1, seed + i, m, None if v is None else float(v)) for m, v in values.items()]
        split.unpersist()
    return rows


def primary_metric(runs: DataFrame) -> str:
    """r2_score, else accuracy, else rmse: the first that occurs anywhere."""
    names = {r[0] for r in runs.where("value is not null").select("metric").distinct().collect()}
    for m in ("r2_score", "accuracy", "rmse"):
        if m in names:
            return m
    raise ValueError(f"no primary metric among {sorted(names)}")


# Scoring names: metric, average and sign. neg_ scores are reported with their sign turned back.
SCORERS = {
    "accuracy": ("accuracy", "macro", 1), "roc_auc": ("roc_auc", "macro", 1), "r2": ("r2_score", None, 1),
    **{f"{m}_{a}": (k, a, 1) for m, k in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))
       for a in ("macro", "weighted")},
    "neg_mean_squared_error": ("mse", None, -1), "neg_mean_absolute_error": ("mae", None, -1),
    "neg_root_mean_squared_error": ("rmse", None, -1),
}
DEFAULT_SCORING = {
    "classification": ["accuracy", "precision_macro", "recall_macro", "f1_macro"],
    "regression": ["neg_mean_squared_error", "r2", "neg_mean_absolute_error", "neg_root_mean_squared_error"],
}


def scored(predictions: DataFrame, task: str, label: str, scoring: Sequence[str]) -> dict[str, float]:
    """The wanted scores of one prediction set, by scoring name."""
    averages = {SCORERS[n][1] for n in scoring} - {None} or {"macro"}
    by_average = {a: score(predictions, task, label, a, "roc_auc" in scoring) for a in averages}
    out = {}
    for name in scoring:
        metric, average, sign = SCORERS[name]
        value = by_average.get(average, next(iter(by_average.values()))).get(metric)
        out[name] = None if value is None else sign * float(value)
    return out


def run_cv(df: DataFrame, ids: Sequence[str], label: str, builder: str | Builder,
           configs: Sequence[AblationConfig] | None = None, folds: int = 5, repeats: int = 1, seed: int = 42,
           task: str = "classification", baseline: bool = True, scoring: Sequence[str] | None = None) -> DataFrame:
    """One row per configuration and repeat: switches, status, fold statistics, time; failures are rows too.

    Each scoring name gives mean_, std_ (population), min_ and max_ columns over the folds.
    """
    scoring = list(scoring or DEFAULT_SCORING[task])
    unknown = [n for n in scoring if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scoring {unknown}; available: {sorted(SCORERS)}")
    spark = df.sparkSession
    plan: list[AblationConfig | None] = ([None] if baseline else []) + list(configs or standard_configs())
    scores, states = [], []
    for r in range(repeats):
        folded = (kfold(df, ids, folds, seed + r) if task == "regression"
                  else stratified_kfold(df, ids, label, folds, seed + r)).persist(StorageLevel.MEMORY_AND_DISK)
        by_fold = []
        for f in range(folds):
            train, test = folded.where(f"fold != {f}").drop("fold"), folded.where(f"fold = {f}").drop("fold")
            start = time.perf_counter()
            found = _outcomes(builder, plan, train, test, task, label, lambda p: scored(p, task, label, scoring))
            by_fold.append((found, (time.perf_counter() - start) / len(plan)))
        for config in plan:
            name = config.name if config else "baseline"
            status, message, done = "success", None, []
            for f, (found, share) in enumerate(by_fold):
                values, seconds = found[name]
                if isinstance(values, Exception):
                    status, message = "failed", f"{type(values).__name__}: {values}"
                    break
                done.append((name, r, f, max(seconds, share), values))
            switches = [getattr(config, t) if config else False for t in TOGGLES]
            note = config.description if config else "Dummy Baseline (most_frequent/mean)"
            states.append((name, r, seed + r, status, message, folds, *switches, note))
            scores += done if status == "success" else []
        folded.unpersist()
    long = spark.createDataFrame(scores, "config_name string, repeat int, fold int, time_sec double, m map<string,double>")
    wide = long.selectExpr("config_name", "repeat", "fold", "time_sec", *[f"m['{n}'] as {n}" for n in scoring])
    stats = metrics.cv_aggregate(wide, scoring, ["config_name", "repeat"]).drop("n_folds")
    table = spark.createDataFrame(
        states, "config_name string, repeat int, random_seed int, status string, error string, n_folds int, "
        + ", ".join(f"{t} boolean" for t in TOGGLES) + ", description string")
    return table.join(stats, ["config_name", "repeat"], "left")


def sanity_matrix(spark: SparkSession, builders: dict[str, Builder], train: DataFrame, test: DataFrame,
                  configs: Sequence[AblationConfig] | None = None) -> DataFrame:
    """Fit every builder under every configuration on small tables: OK, FAIL or EXC per cell.

    FAIL is a pipeline that cannot be built, EXC one that breaks in fit or predict.
    """
    rows = []
    for name, fn in builders.items():
        for config in configs or standard_configs():
            try:
                pipeline = build(fn, config)
            except Exception as error:
                rows.append((name, config.name, "FAIL", str(error)))
                continue
            try:
                n = pipeline.fit(train).transform(test).count()
                rows.append((name, config.name, "OK", f"{n} rows"))
            except Exception as error:
                rows.append((name, config.name, "EXC", f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, "builder string, configuration string, status string, message string")


def fit_predict_time(pipeline, train: DataFrame, test: DataFrame) -> tuple[float, float]:
    """Elapsed seconds of fit and of a full prediction pass."""
    start = time.perf_counter()
    model = pipeline.fit(train)
    fitted = time.perf_counter()
    model.transform(test).write.format("noop").mode("overwrite").save()
    return fitted - start, time.perf_counter() - fitted

"""Component refinement, tuned candidates, their vote, and feature ablation."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learners, metrics, stages, voting
from ..operators.features import fit_scaler, select_k_best
from ..session import concurrently
from .ablation import broken_configuration


def f1_of_one(predictions: DataFrame, label: str = "label") -> float:
    return metrics.binary_metrics(predictions, label, "prediction").first()["f1_score"]


def _quick_score(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> float:
    parts = stages.assemble(columns)
    model = learners.logistic(label=label).fit(parts.transform(train))
    return f1_of_one(model.transform(parts.transform(test)), label)


def refine_component(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label",
                     rfe_keep: int = 10) -> DataFrame:
    """Score each scaler and each selector with one quick model: (component, alternative, score, best).

    Only a strictly greater score replaces the best so far, starting from 0, so a component
    may end without a winner. An alternative that fails is skipped.
    """
    def scaler(kind):
        fitted = fit_scaler(train, columns, kind)
        return _quick_score(fitted.transform(train), fitted.transform(test), columns, label)

    def top(k):
        chosen = [r["column"] for r in select_k_best(train, label, columns, k).collect()]
        return _quick_score(train, test, chosen, label)

    def rfe():
        kept = learners.recursive_elimination(stages.assemble(columns).transform(train), min(rfe_keep, len(columns)),
                                              label=label)
        return _quick_score(train, test, [columns[i] for i in kept], label)

    tasks = [("scaler", "standard", lambda: scaler("standard")), ("scaler", "robust", lambda: scaler("robust")),
             ("selector", "selectkbest_10", lambda: top(10)), ("selector", "selectkbest_15", lambda: top(15)),
             ("selector", f"rfe_{rfe_keep}", rfe)]
    rows, best = [], {"scaler": (None, 0.0), "selector": (None, 0.0)}
    for component, name, run in tasks:
        try:
            value = run()
        except Exception as error:
            if not broken_configuration(error):
                raise
            print(f"skipped {component} {name}: {type(error).__name__}")
            continue
        rows.append((component, name, value))
        if value is not None and value > best[component][1]:
            best[component] = (name, value)
    table = train.sparkSession.createDataFrame(rows, "component string, alternative string, score double")
    winners = ", ".join(f"'{c}', {repr(n) if n else 'null'}" for c, (n, _) in best.items())
    return table.withColumn("best", F.expr(f"coalesce(map({winners})[component] = alternative, false)"))


def candidate_models(train: DataFrame, test: DataFrame, label: str = "label", fold: str | None = None,
                     folds: int = 3, searches: dict | None = None):
    """Fit and tune the candidate families; returns ([(name, model)], rows (name, score, seconds)).

    ``searches`` maps a name to an estimator or a search; by default the five families of ``default_searches``. Candidates are scored by F1 of class 1.
    """
    plan = searches or default_searches(train, label, fold, folds)
    fitted, rows = [], []
    for name, search in plan.items():
        start = time.perf_counter()
        model = search.fit(train)
        model = getattr(model, "bestModel", model)
        fitted.append((name, model))
        rows.append((name, float(f1_of_one(model.transform(test), label)), time.perf_counter() - start))
    table = train.sparkSession.createDataFrame(rows, "name string, score double, seconds double")
    return fitted, table


def default_searches(train: DataFrame, label: str, fold: str | None, folds: int, grids: Mapping | None = None) -> dict:
    """The five candidate families by name: a sampled forest search, a boosting grid, the logistic C grid, a sampled search of boosting
    on row samples, and a grid of deeper boosting.

    ``grids`` replaces the grids of learners.GRIDS by family: (grid, number of draws or None for all points).
    """
    n = train.count() * (folds - 1) / folds
    regs = {"regParam": [1.0 / (c * n) for c in learners.LOGISTIC_C]}
    base = learners.LogisticRegression(labelCol=label, maxIter=1000, elasticNetParam=0.0, standardization=False)

    def search(family: str, estimator):
        grid, draws = (grids or learners.GRIDS)[family]
        if draws is None:
            return learners.grid_search(estimator, grid, "f1", fold, folds, label)
        return learners.random_search(estimator, grid, draws, "f1", fold, folds, label)

    return {
        "Tuned Random Forest": search("forest", learners.forest(label=label)),
        "Tuned Gradient Boosting": search("boosting", learners.boosting(label=label)),
        "Tuned Logistic Regression": learners.grid_search(base, regs, "f1", fold, folds, label),
        "Tuned Stochastic Boosting": search("stochastic", learners.boosting(label=label)),
        "Tuned Deep Boosting": search("deep", learners.boosting(label=label)),
    }


def ensemble_scores(fitted, scores: DataFrame, test: DataFrame, classes: Sequence | None = None,
                    label: str = "label") -> DataFrame:
    """Hard vote against the F1-squared weighted soft vote: voting_score, weighted_score, best_ensemble.

    The classes are those of the fitted models unless they are given.
    """
    from pyspark.ml.functions import vector_to_array

    classes = classes or [float(c) for c in range(max(getattr(m, "numClasses", 2) for _, m in fitted))]
    by_name = {r["name"]: r["score"] for r in scores.collect()}
    data, preds, probs = test, [], []
    have = set(test.columns)
    for i, (_, model) in enumerate(fitted):
        data = model.transform(data)
        made = [c for c in data.columns if c not in have and not c.startswith("__v")]
        soft = "probability" in made
        data = data.withColumns({f"__v{i}": F.col("prediction")} | (
            {f"__v{i}_{j}": vector_to_array("probability")[j] for j in range(len(classes))} if soft else {})).drop(*made)
        preds.append(f"__v{i}")
        probs.append([f"__v{i}_{j}" for j in range(len(classes))] if soft else None)
    members = [(p, by_name[n]) for p, (n, _) in zip(probs, fitted) if p]
    hard = voting.vote_hard(data, preds, "prediction")
    voting_score = f1_of_one(hard, label)
    weights = voting.member_weights([s for _, s in members])
    weighted = 0.0
    if any(w is not None for w in weights):
        soft = voting.vote_soft(data, [p for p, _ in members], list(classes), weights, "prediction")
        weighted = f1_of_one(soft, label)
    row = test.sparkSession.createDataFrame([(voting_score, weighted)], "voting_score double, weighted_score double")
    return voting.best_ensemble(row)


#: Rows times trees of the forests that are fitted side by side: each keeps some 12 bytes for every one of them.
ROW_TREES = 200_000_000


def feature_ablation(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label", top: int = 5,
                     trees: int = 100, depth: int | None = None, seed: int = 42) -> DataFrame:
    """(removed, importance, score, drop): refit without each of the most important features.

    The columns are computed once. The refits don't wait for each other, as far as ``ROW_TREES`` allows.
    """
    used = list(dict.fromkeys([*columns, label]))
    train, test = (d.select(*[F.col(f"`{c}`") for c in used]).persist(StorageLevel.MEMORY_AND_DISK) for d in (train, test))
    try:
        n = train.count()
        fitted = learners.in_few_tasks(train, n) if learners.deep(depth) else train

        def fit_score(cols):
            parts = stages.assemble(cols)
            model = learners.forest(trees=trees, depth=depth, seed=seed, label=label).fit(parts.transform(fitted))
            return model, float(f1_of_one(model.transform(parts.transform(test)), label))

        model, base = fit_score(columns)
        weight = learners.importances(model)
        order = sorted(range(len(columns)), key=lambda i: (-weight[i], i))[:top]
        scores = concurrently([lambda i=i: fit_score([c for c in columns if c != columns[i]])[1] for i in order],
                              max(1, min(len(order), ROW_TREES // max(1, n * trees))))
    finally:
        train.unpersist()
        test.unpersist()
    rows = [("(none)", None, base, 0.0)] + [(columns[i], weight[i], value, base - value) for i, value in zip(order, scores)]
    return train.sparkSession.createDataFrame(rows, "removed string, importance double, score double, drop double")

"""Model families with the usual library parameters mapped onto pyspark.ml.

Penalties given per summed loss (C, alpha) depend on the row count, so those learners
count their training rows first. All take ``features`` and ``label`` columns and write a
``prediction`` (and, for classifiers that have them, ``probability``) column.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import concurrently
from . import voting
from .stages import FittedStage, LearnStage, fourier_features, slice_features, stage_key

MAX_DEPTH = 30  # Spark's cap; stands for "no limit"


def logistic(c: float = 1.0, max_iter: int = 1000, features: str = "features", label: str = "label") -> LearnStage:
    """Multinomial logistic regression; C is the inverse of a penalty on the summed loss."""
    def learn(df: DataFrame):
        n = df.count()
        return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1.0 / (c * n),
                                  elasticNetParam=0.0, standardization=False, tol=1e-8).fit(df)

    return LearnStage(learn, "LogisticRegression", (c, max_iter, features, label))


def linear(features: str = "features", label: str = "label") -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal")


def ridge(alpha: float = 1.0, features: str = "features", label: str = "label") -> LearnStage:
    """L2 regression with alpha on the summed loss: Spark scales the label by its spread."""
    def learn(df: DataFrame):
        n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
        return LinearRegression(featuresCol=features, labelCol=label, solver="normal", elasticNetParam=0.0,
                                regParam=alpha * (sd or 1.0) / n, standardization=False).fit(df)

    return LearnStage(learn, "Ridge", (alpha, features, label))


def deep(depth: int | None) -> bool:
    """Whether trees of this depth may have nearly as many nodes as rows."""
    return (depth or MAX_DEPTH) > 10


def forest(task: str = "classification", trees: int = 100, depth: int | None = 5, seed: int = 42,
           features: str = "features", label: str = "label", **options):
    """``depth`` None grows trees as deep as Spark allows. Rows of deep trees remember their nodes: otherwise every round sends all
    trees so far to all tasks and routes each row from the root again. The trees are the same."""
    options = {"cacheNodeIds": deep(depth)} | options
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return cls(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH),
               seed=seed, **options)


#: Tasks of a forest: as many as its rows fill with FEWEST rows each, but no more than FOREST_TASKS unless these had more than MOST.
FOREST_TASKS, FEWEST, MOST = 3, 5_000, 300_000


def in_few_tasks(train: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows in few partitions, as a forest likes them.

    In every round of a forest each task makes and sends statistics of all the round's nodes, even if it has no row of most of them. Deep
    trees have nearly as many nodes as rows, so with more tasks the statistics are most of the work. Rows are dealt
    evenly and sorted, so that a forest's draws don't depend on the order in which they arrive.
    """
    parts = max(-(-n // MOST), min(FOREST_TASKS, -(-n // FEWEST)), 1)
    if train.rdd.getNumPartitions() <= parts:
        return train
    return train.repartition(parts).sortWithinPartitions(*[F.col(f"`{c}`") for c in train.columns])


def boosting(task: str = "classification", trees: int = 100, rate: float = 0.1, depth: int = 3, seed: int = 42,
             classes: int = 2, features: str = "features", label: str = "label", **options):
    """One family for all boosted-tree libraries; more than two classes go one-vs-rest."""
    common = dict(featuresCol=features, labelCol=label, maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed)
    if task != "classification":
        return GBTRegressor(**common, **options)
    model = GBTClassifier(**common, **options)
    return model if classes == 2 else OneVsRest(classifier=model, featuresCol=features, labelCol=label)


def svc_rbf(c: float = 10.0, gamma: float | str = "scale", components: int = 256, classes: int = 2,
            features: str = "features", label: str = "label", seed: int = 42, max_iter: int = 100) -> Pipeline:
    """RBF-kernel SVM: random Fourier features under a linear SVM (one-vs-rest beyond two classes)."""
    def learn(df: DataFrame):
        n = df.count()
        svm = LinearSVC(featuresCol="__rbf", labelCol=label, regParam=1.0 / (c * n), maxIter=max_iter)
        if classes > 2:
            svm = OneVsRest(classifier=svm, featuresCol="__rbf", labelCol=label)
        model = svm.fit(df)
        return FittedStage(lambda d: model.transform(d).drop("__rbf"), model)

    return Pipeline(stages=[fourier_features(components, gamma, features, "__rbf", seed), LearnStage(learn, "SVC")])


def svc_rbf_converged(c: float = 10.0, gamma: float | str = "scale", start: int = 64, most: int = 4096, tolerance: float = 0.01,
                      classes: int = 2, features: str = "features", label: str = "label", seed: int = 42,
                      max_iter: int = 100) -> LearnStage:
    """``svc_rbf`` with as many random features as its decisions need.

    The number is doubled, each time with features of their own, until at most a share ``tolerance`` of held-out rows changes its
    decision; the last machine is then fitted on all rows. A fifth of the rows, by a hash of vector and label, is held out. Two
    machines with unlike features differ by both errors, so the change also bounds what the approximation does to a decision.
    The fitted stage's detail has ``components``, ``changes`` (features, twice as many, share changed) and ``converged``, which is
    False where ``most`` features are not enough.
    """
    def learn(df: DataFrame):
        data = df.select(features, label).withColumn(
            "__held", F.pmod(F.xxhash64(vector_to_array(features), label, F.lit(seed)), F.lit(5)) == 0).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            width = fourier_features(1, gamma, features, "__rbf", seed).fit(data).detail["gamma"]
            fitted, held = data.where("not __held"), data.where("__held").drop("__held")

            def machine(rows: DataFrame, number: int):
                return svc_rbf(c, width, number, classes, features, label, seed + number, max_iter).fit(rows)

            def decided(rows: DataFrame, model, name: str) -> DataFrame:
                return model.transform(rows).withColumn(name, F.col("prediction")).drop("prediction", "rawPrediction")

            number, small, changes = start, machine(fitted, start), []
            while 2 * number <= most:
                large = machine(fitted, 2 * number)
                both = decided(decided(held, small, "__small"), large, "__large")
                change = both.agg(F.avg((F.col("__small") != F.col("__large")).cast("double"))).first()[0]
                changes.append((number, 2 * number, 0.0 if change is None else change))
                number, small = 2 * number, large
                if changes[-1][2] <= tolerance:
                    break
            whole = machine(data, number)
        finally:
            data.unpersist()
        detail = {"components": number, "gamma": width, "changes": changes, "converged": bool(changes) and changes[-1][2] <= tolerance}
        return FittedStage(whole.transform, detail)

    return LearnStage(learn, "SVC", (c, gamma, start, most, tolerance, classes, features, label, seed, max_iter))


def perceptron(hidden: Sequence[int], inputs: int, classes: int, features: str = "features", label: str = "label",
               max_iter: int = 100, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[inputs, *hidden, classes],
                                          maxIter=max_iter, seed=seed)


# --- tuning ------------------------------------------------------------------------------------

def evaluator(scoring: str, label: str = "label"):
    """accuracy, f1 (of class 1, not the weighted one), f1_weighted, r2, rmse, mae, mse."""
    if scoring == "f1":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    if scoring == "accuracy":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    if scoring == "f1_weighted":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    return RegressionEvaluator(labelCol=label, metricName=scoring)


def _param_maps(estimator: Estimator, points: Sequence[Mapping]) -> list[dict]:
    return [{estimator.getParam(k): v for k, v in p.items()} for p in points]


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sample_points(grid: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n distinct points of the grid (all of them if there are fewer)."""
    points = grid_points(grid)
    return points if n >= len(points) else random.Random(seed).sample(points, n)


def grid_search(estimator: Estimator, grid: Mapping[str, Sequence], scoring: str = "f1", fold: str | None = None,
                folds: int = 3, label: str = "label", parallelism: int = 4, seed: int = 42) -> CrossValidator:
    """Exhaustive search with refit; pass a fold column to fix the folds."""
    return _search(estimator, grid_points(grid), scoring, fold, folds, label, parallelism, seed)


def random_search(estimator: Estimator, grid: Mapping[str, Sequence], n: int, scoring: str = "f1",
                  fold: str | None = None, folds: int = 3, label: str = "label", parallelism: int = 4,
                  seed: int = 42) -> CrossValidator:
    return _search(estimator, sample_points(grid, n, seed), scoring, fold, folds, label, parallelism, seed)


def _search(estimator, points, scoring, fold, folds, label, parallelism, seed) -> CrossValidator:
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=_param_maps(estimator, points),
                        evaluator=evaluator(scoring, label), numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.setFoldCol(fold) if fold else cv


# Search grids of the churn study in Spark parameter names.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4], "bootstrap": [True, False]}
BOOSTING_GRID = {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]}
STOCHASTIC_GRID = {"maxIter": [100, 200, 500], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 0.8, 0.9]}
DEEP_GRID = {"maxIter": [200, 500], "stepSize": [0.01, 0.1], "maxDepth": [4, 6, 8]}
LOGISTIC_C = [0.1, 1.0, 10.0]
#: Grid and number of draws (None: every point) by family.
GRIDS = {"forest": (FOREST_GRID, 50), "boosting": (BOOSTING_GRID, None), "stochastic": (STOCHASTIC_GRID, 20), "deep": (DEEP_GRID, None)}


# --- model-based selection -----------------------------------------------------------------------

def importances(model) -> list[float]:
    return [float(v) for v in model.featureImportances.toArray()]


def recursive_elimination(train: DataFrame, keep: int, features: str = "features", label: str = "label",
                          trees: int = 100, depth: int | None = None, seed: int = 42) -> list[int]:
    """Drop the least important feature per round until ``keep`` are left; indices into the vector.

    The loop only carries indices; every round is one distributed forest fit.
    """
    left = list(range(train.select(features).first()[0].size))
    data = train.select(features, label).persist()
    try:
        while len(left) > keep:
            view = slice_features(left, features, "__sub").transform(data)
            scores = importances(forest(trees=trees, depth=depth, seed=seed, features="__sub", label=label).fit(view))
            left.pop(min(range(len(left)), key=lambda i: (scores[i], -i)))
    finally:
        data.unpersist()
    return left


def select_from_model(train: DataFrame, features: str = "features", label: str = "label", trees: int = 50,
                      seed: int = 42) -> list[int]:
    """Indices whose boosted-tree importance is at least the mean importance."""
    scores = importances(boosting("regression", trees=trees, seed=seed, features=features, label=label).fit(
        train.select(features, label)))
    mean = sum(scores) / len(scores)
    return [i for i, s in enumerate(scores) if s >= mean]


# --- ensembles -------------------------------------------------------------------------------------

class Ensemble:
    """A combination of estimators as a pipeline step: ``stage()`` fits it, ``single()`` is what is left without it."""

    def stage(self) -> LearnStage:
        raise NotImplementedError

    def single(self):
        raise NotImplementedError


def _member_keys(members) -> tuple:
    return tuple((n, stage_key(_stage(e))) for n, e in members)


def _stage(estimator):
    return estimator.stage() if isinstance(estimator, Ensemble) else estimator


def _columns(models, data: DataFrame, classes: Sequence | None) -> tuple[DataFrame, list[str], list[list[str]]]:
    """One projection chain over all models: a column per prediction and, with classes, per class probability."""
    have = set(data.columns)
    preds, probs = [], []
    for i, (_, m) in enumerate(models):
        data = m.transform(data)
        made = [c for c in data.columns if c not in have and not c.startswith("__m")]
        soft = classes is not None and "probability" in made
        data = data.withColumn(f"__m{i}", F.col("prediction"))
        preds.append(f"__m{i}")
        probs.append([f"__m{i}_{j}" for j in range(len(classes))] if soft else [])
        if soft:
            data = data.withColumns({c: vector_to_array("probability")[j] for j, c in enumerate(probs[-1])})
        data = data.drop(*made)
    return data, preds, probs


def _classes(models) -> list[float]:
    fitted = [getattr(m, "bestModel", m) for _, m in models]
    return [float(c) for c in range(max(getattr(m, "numClasses", 2) for m in fitted))]


@dataclass
class Voting(Ensemble):
    """Members (name, estimator) of a hard, soft or mean vote; without the vote the first member is left."""

    members: Sequence[tuple[str, Estimator]]
    kind: str = "hard"
    weights: Sequence[float | None] | None = None
    classes: Sequence | None = None
    label: str = "label"

    def single(self):
        return self.members[0][1] if self.members else self

    def stage(self) -> LearnStage:
        def learn(df: DataFrame):
            fits = concurrently([lambda e=e: _stage(e).fit(df) for _, e in self.members])
            models = [(n, m) for (n, _), m in zip(self.members, fits)]
            classes = list(self.classes) if self.classes else _classes(models)

            def apply(d: DataFrame) -> DataFrame:
                d, preds, probs = _columns(models, d, classes if self.kind == "soft" else None)
                if self.kind == "hard":
                    d = voting.vote_hard(d, preds, "prediction")
                elif self.kind == "soft":
                    d = voting.vote_soft(d, probs, classes, self.weights, "prediction")
                    d = d.withColumn("probability", array_to_vector("prediction_proba")).drop("prediction_proba")
                else:
                    d = voting.vote_regressor(d, preds, "prediction")
                return d.drop(*preds, *[c for p in probs for c in p])

            return FittedStage(apply, models)

        return LearnStage(learn, "Voting", (_member_keys(self.members), self.kind, tuple(self.weights or ()), tuple(self.classes or ()), self.label))


def _row_key(df: DataFrame, ids: Sequence[str] | None):
    """What tells rows apart, whatever their partition: the ids, or else all columns."""
    return [F.col(f"`{c}`") for c in (ids or df.columns)]


@dataclass
class Stacking(Ensemble):
    """Members whose out-of-fold outputs train a final learner; without it the final learner is left, or the first member.

    Folds are cut by a hash of the ids (of all columns, if there are none): every member is fitted once without each fold and
    predicts that fold, so the final learner never sees an output for a row that the member was fitted on. Members are then
    fitted on all rows. Outputs are the class probabilities (without the first class if there are two), or the prediction.
    ``final`` is a logistic regression by default, a linear one for a regression.
    """

    members: Sequence[tuple[str, Estimator]]
    final: Estimator | None = None
    task: str = "classification"
    folds: int = 5
    ids: Sequence[str] | None = None
    features: str = "features"
    label: str = "label"
    passthrough: bool = False
    seed: int = 42

    def single(self):
        return self.final if self.final is not None else self.members[0][1] if self.members else self

    def _meta(self, models, df: DataFrame, classes: Sequence | None) -> DataFrame:
        """Rows with the members' outputs as the vector ``__stack``."""
        data, preds, probs = _columns(models, df, classes)
        outputs = [c for pred, prob in zip(preds, probs) for c in (prob[1:] if len(prob) == 2 else prob or [pred])]
        inputs = outputs + ([self.features] if self.passthrough else [])
        made = VectorAssembler(inputCols=inputs, outputCol="__stack").transform(data)
        return made.drop(*preds, *[c for p in probs for c in p])

    def stage(self) -> LearnStage:
        def learn(df: DataFrame):
            number = F.pmod(F.xxhash64(*_row_key(df, self.ids), F.lit(self.seed)), F.lit(self.folds))
            folded = df.withColumn("__fold", number.cast("int"))
            parts = [folded.where(f"__fold != {f}").drop("__fold") for f in range(self.folds)] + [df]
            fits = concurrently([lambda e=e, d=d: _stage(e).fit(d) for d in parts for _, e in self.members])
            size = len(self.members)
            models = [[(n, fits[k * size + i]) for i, (n, _) in enumerate(self.members)] for k in range(len(parts))]
            classes = None if self.task == "regression" else _classes(models[-1])
            held_out = [self._meta(models[f], folded.where(f"__fold = {f}").drop("__fold"), classes) for f in range(self.folds)]
            meta = reduce(DataFrame.unionByName, held_out).select(F.col("__stack").alias(self.features), self.label)
            meta = meta.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                final = self.final if self.final is not None else (
                    linear(self.features, self.label) if self.task == "regression" else logistic(1.0, 100, self.features, self.label))
                last = _stage(final).fit(meta)
            finally:
                meta.unpersist()

            def apply(d: DataFrame) -> DataFrame:
                own = d.withColumn("__own", F.col(self.features))
                met = self._meta(models[-1], own, classes).withColumn(self.features, F.col("__stack")).drop("__stack")
                return last.transform(met).withColumn(self.features, F.col("__own")).drop("__own")

            return FittedStage(apply, {"members": models[-1], "final": last, "out_of_fold": models[:-1]})

        return LearnStage(learn, "Stacking")


#: Draws of a row beyond this have a probability below 10^-9 and count as this many.
MOST_DRAWS = 12


def poisson_draws(key: Sequence, seed: int):
    """How often a row is drawn into a bootstrap sample, from a hash of its key: Poisson with mean 1."""
    share = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / float(1 << 53)
    total, term, draws = 0.0, math.exp(-1), F.lit(MOST_DRAWS)
    edges = []
    for k in range(MOST_DRAWS):
        total += term
        term /= k + 1
        edges.append((k, total))
    for k, edge in reversed(edges):
        draws = F.when(share < edge, F.lit(k)).otherwise(draws)
    return draws.cast("double")


@dataclass
class Bagging(Ensemble):
    """Copies of ``base`` on bootstrap samples, averaged; without it the base is left.

    A sample is a weight column: each row's draws come from a hash of its ids (of all columns, if there are none) and the member's
    number, so no row is copied and samples don't depend on the partitions. The base needs a weight column. The fitted
    stage's detail has ``oob_score``: accuracy (R2 for a regression) where each row is judged by the members that never drew it.
    """

    base: Estimator
    members: int = 10
    task: str = "classification"
    ids: Sequence[str] | None = None
    label: str = "label"
    seed: int = 42
    oob: bool = True

    def single(self):
        return self.base

    def draws(self, df: DataFrame, member: int):
        return poisson_draws(_row_key(df, self.ids), self.seed * 10_007 + member)

    def stage(self) -> LearnStage:
        if not self.base.hasParam("weightCol"):
            raise TypeError(f"{type(self.base).__name__} has no weight column, which bagging needs")
        base = self.base.copy({self.base.getParam("weightCol"): "__draws"})

        def fit(df: DataFrame, member: int):
            return base.fit(df.withColumn("__draws", self.draws(df, member)).where("__draws > 0"))

        def learn(df: DataFrame):
            fits = concurrently([lambda i=i: fit(df, i) for i in range(self.members)])
            models = [(f"bag_{i}", m) for i, m in enumerate(fits)]
            classes = None if self.task == "regression" else _classes(models)

            def average(d: DataFrame, uses: Sequence[str]) -> DataFrame:
                """Adds the mean over the members whose condition holds."""
                d, preds, probs = _columns(models, d, classes)
                use = [f"({u})" for u in uses]
                total = " + ".join(f"if({u}, 1, 0)" for u in use)
                mean = lambda cols: f"({' + '.join(f'if({u}, {c}, 0D)' for u, c in zip(use, cols))}) / nullif({total}, 0)"
                if classes is None:
                    d = d.withColumn("prediction", F.expr(mean(preds)))
                else:
                    shares = [mean([p[j] if p else f"if({c} = {k}, 1D, 0D)" for p, c in zip(probs, preds)]) for j, k in enumerate(classes)]
                    d = d.withColumn("__mean", F.expr(f"array({', '.join(shares)})")).withColumn(
                        "prediction", F.expr("cast(array_position(__mean, array_max(__mean)) - 1 as double)")).withColumn(
                        "probability", array_to_vector("__mean")).drop("__mean")
                return d.drop(*preds, *[c for p in probs for c in p])

            score = None
            if self.oob:
                unseen = [f"__u{i}" for i in range(self.members)]
                marked = df.withColumns({u: self.draws(df, i) == 0 for i, u in enumerate(unseen)})
                judged = average(marked, unseen).where(" or ".join(unseen))
                y = F.col(self.label)
                if self.task == "regression":
                    score = judged.agg(1 - F.sum((y - F.col("prediction")) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).first()[0]
                else:
                    score = judged.agg(F.avg((y == F.col("prediction")).cast("double"))).first()[0]
            return FittedStage(lambda d: average(d, ["true"] * self.members), {"members": models, "oob_score": score})

        return LearnStage(learn, "Bagging")

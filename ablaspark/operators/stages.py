"""Feature stages for pyspark.ml pipelines that the built-in set does not cover.

A stage works on named columns until the vector is assembled, so the same exact
statistics serve the SQL forms and the pipelines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import (
    PCA, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, real
from .cleaning import FittedColumns
from .features import fit_imputer, fit_scaler


class FittedStage(Model):
    """A learned projection as an ML model."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame], detail=None):
        super().__init__()
        self.apply, self.detail = apply, detail

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset)


class LearnStage(Estimator):
    """An estimator from a function ``train -> FittedStage`` (or anything with ``transform``).

    ``key`` tells stages that do the same apart from others (see ``stage_key``); without one a stage is like no other.
    """

    def __init__(self, learn: Callable[[DataFrame], object], label: str = "stage", key: tuple | None = None):
        super().__init__()
        self.learn, self.label, self.key = learn, label, key

    def _fit(self, dataset: DataFrame):
        fitted = self.learn(dataset)
        return fitted if isinstance(fitted, Transformer) else FittedStage(fitted.transform, fitted)


class ApplyStage(Transformer):
    """A fixed transformation as a stage."""

    def __init__(self, apply: Callable[[DataFrame], DataFrame], label: str = "stage", key: tuple | None = None):
        super().__init__()
        self.apply, self.label, self.key = apply, label, key

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset)


def stage_key(stage) -> tuple:
    """Equal for stages that do the same: class and parameters, or the key that a function's stage was given."""
    if isinstance(stage, (LearnStage, ApplyStage)):
        return (stage.label, stage.key) if stage.key is not None else ("object", id(stage))
    if isinstance(stage, Pipeline):
        return ("Pipeline", *map(stage_key, stage.getStages()))
    if not hasattr(stage, "extractParamMap"):
        return ("object", id(stage))
    plain = (str, int, float, bool, type(None))
    values = []
    for p, v in stage.extractParamMap().items():
        if isinstance(v, (list, tuple)) and all(isinstance(x, plain) for x in v):
            v = tuple(v)
        elif not isinstance(v, plain):
            v = stage_key(v)
        values.append((p.name, v))
    return (type(stage).__name__, *sorted(values, key=lambda x: x[0]))


def impute(columns: Sequence[str], strategy: str = "mean") -> LearnStage:
    return LearnStage(lambda df: fit_imputer(df, columns, strategy), "imputer", (tuple(columns), strategy))


def scale(columns: Sequence[str], kind: str = "standard") -> LearnStage:
    return LearnStage(lambda df: fit_scaler(df, columns, kind), "scaler", (tuple(columns), kind))


def assemble(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def _yeo_johnson(x: str, lam: str) -> str:
    pos = f"case when abs({lam}) < 1e-12 then log1p({x}) else (power({x} + 1, {lam}) - 1) / {lam} end"
    neg = (f"case when abs({lam} - 2) < 1e-12 then -log1p(-{x})"
           f" else -(power(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) end")
    return f"case when {x} >= 0 then {pos} else {neg} end"


def _power_variances(base: DataFrame, grids: dict[int, np.ndarray]) -> dict[tuple[int, int], float]:
    """Population variance of column x<i> under the j-th exponent of its grid, by (i, j); without values there is none.

    Tasks send count, mean and squared deviations of their rows, which are then put together. A logarithm serves all exponents.
    """
    def stretched(logs: np.ndarray, lam: float) -> np.ndarray:
        return logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam

    def joined(a: tuple, b: tuple) -> tuple:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n

    def moments(batches):
        held = {}
        with np.errstate(all="ignore"):  # what overflows is no likely exponent
            for batch in batches:
                for i, grid in grids.items():
                    x = batch[f"x{i}"].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    if not len(x):
                        continue
                    above, below = np.log1p(x[x >= 0]), np.log1p(-x[x < 0])
                    for j, lam in enumerate(grid):
                        y = np.concatenate([stretched(above, lam), -stretched(below, 2 - lam)])
                        mean = y.mean()
                        found = (len(y), float(mean), float(np.square(y - mean).sum()))
                        held[i, j] = joined(held[i, j], found) if (i, j) in held else found
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["i", "j", "n", "mean", "squares"])

    whole = {}
    for r in base.mapInPandas(moments, "i int, j int, n bigint, mean double, squares double").collect():
        found = (r["n"], *(np.nan if v is None else v for v in (r["mean"], r["squares"])))  # Arrow sends NaN as NULL
        whole[r["i"], r["j"]] = joined(whole[r["i"], r["j"]], found) if (r["i"], r["j"]) in whole else found
    return {k: squares / n for k, (n, _, squares) in whole.items()}


def fit_power(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-6, points: int = 9,
              span: tuple[float, float] = (-4.0, 6.0), most_rounds: int = 60) -> FittedColumns:
    """Yeo-Johnson with the maximum-likelihood exponent per column, then mean 0 and sd 1.

    Each round scores a grid of exponents for all open columns in one pass and narrows every bracket to the points beside its
    best one; a best point on the rim moves the bracket on instead. A column is done when its bracket is narrower than
    ``tolerance``; a search that does not get there is an error. In the last rounds neighbours differ by rounding only, so the peak of the
    parabola in the last round with a step above 1e-4 is taken where it agrees. A column without spread keeps the exponent 1.
    """
    base = df.select(*[F.expr(real(f"cast({q(c)} as double)")).alias(f"x{i}") for i, c in enumerate(columns)])
    slope = base.agg(*[F.expr(f"sum(sign(x{i}) * log1p(abs(x{i})))").alias(f"l{i}") for i in range(len(columns))],
                     *[F.expr(f"count(x{i})").alias(f"n{i}") for i in range(len(columns))]).first()
    bounds = dict.fromkeys(range(len(columns)), span)
    best, peaks = [1.0] * len(columns), {}
    for _ in range(most_rounds):
        if not bounds:
            break
        grids = {i: np.linspace(lo, hi, points) for i, (lo, hi) in bounds.items()}
        spread = _power_variances(base, grids)
        for i, grid in grids.items():
            n = slope[f"n{i}"]
            like = [-np.inf if not spread.get((i, j)) or not np.isfinite(spread[i, j])
                    else -n / 2 * np.log(spread[i, j]) + (lam - 1) * slope[f"l{i}"] for j, lam in enumerate(grid)]
            if not n or np.max(like) == -np.inf:
                del bounds[i]
                continue
            j, step = int(np.argmax(like)), grid[1] - grid[0]
            best[i] = float(grid[j])
            if 0 < j < points - 1 and step > 1e-4 and np.isfinite(like[j - 1:j + 2]).all():
                bend = like[j - 1] - 2 * like[j] + like[j + 1]
                peaks[i] = float(grid[j] + step / 2 * (like[j - 1] - like[j + 1]) / bend) if bend < 0 else best[i]
            # on the rim the bracket keeps its width
            half = step if 0 < j < points - 1 else (points - 1) * step / 2
            bounds[i] = (grid[j] - half, grid[j] + half)
            if 2 * half < tolerance:
                del bounds[i]
    if bounds:
        raise ArithmeticError(f"no power exponent within {most_rounds} rounds for {[columns[i] for i in bounds]}")
    best = [peaks[i] if i in peaks and abs(peaks[i] - lam) <= tolerance else lam for i, lam in enumerate(best)]
    lambdas = dict(zip(columns, best))
    shaped = {c: _yeo_johnson(f"cast({q(c)} as double)", f"{lam!r}D") for c, lam in lambdas.items()}
    moments = df.agg(*[F.expr(f"avg({e})").alias(f"m{i}") for i, e in enumerate(shaped.values())],
                     *[F.expr(f"stddev_pop({e})").alias(f"s{i}") for i, e in enumerate(shaped.values())]).first()
    fitted = FittedColumns({
        c: f"({e} - {moments[f'm{i}']!r}D) / {(moments[f's{i}'] or 1.0)!r}D"
        for i, (c, e) in enumerate(shaped.items()) if moments[f"m{i}"] is not None})
    object.__setattr__(fitted, "lambdas", lambdas)
    return fitted


def power(columns: Sequence[str]) -> LearnStage:
    return LearnStage(lambda df: fit_power(df, columns), "power", tuple(columns))


def one_hot(columns: Sequence[str], suffix: str = "_hot") -> Pipeline:
    """Indicator vectors per category; a category unseen in training is all zeros."""
    index = [f"{c}__index" for c in columns]
    wide = [f"{c}__wide" for c in columns]
    indexer = StringIndexer(inputCols=list(columns), outputCols=index, handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=index, outputCols=wide, dropLast=True)

    def rename(df: DataFrame) -> DataFrame:
        # "keep" adds one slot for unseen values; dropLast takes exactly that slot away.
        return df.withColumnsRenamed({w: f"{c}{suffix}" for w, c in zip(wide, columns)}).drop(*index)

    return Pipeline(stages=[indexer, encoder, ApplyStage(rename, "rename")])


def column_transformer(groups: Sequence[tuple[Sequence, Sequence[str]]], output: str = "features") -> Pipeline:
    """Chains of stages over column groups; only their outputs go into the vector.

    ``groups`` holds (stages, output columns of those stages).
    """
    stages = [s for chain, _ in groups for s in chain]
    return Pipeline(stages=[*stages, assemble([c for _, outs in groups for c in outs], output)])


def variance_pca(inputs: str = "features", output: str = "pca", share: float = 0.95) -> LearnStage:
    """PCA on centred vectors keeping the fewest components that explain ``share`` of variance."""
    def learn(df: DataFrame):
        width = df.select(inputs).first()[0].size
        centre = StandardScaler(inputCol=inputs, outputCol=f"{output}__c", withMean=True, withStd=False).fit(df)
        full = PCA(k=width, inputCol=f"{output}__c", outputCol=f"{output}__all").fit(centre.transform(df))
        ratios = np.array(full.explainedVariance.toArray())
        keep = min(width, int(np.searchsorted(np.cumsum(ratios), share - 1e-12)) + 1)
        cut = VectorSlicer(inputCol=f"{output}__all", outputCol=output, indices=list(range(keep)))

        def apply(d: DataFrame) -> DataFrame:
            return cut.transform(full.transform(centre.transform(d))).drop(f"{output}__c", f"{output}__all")

        return FittedStage(apply, {"ratios": ratios.tolist(), "k": keep})

    return LearnStage(learn, "pca", (inputs, output, share))


def select_f(k: int, inputs: str = "features", output: str = "selected", label: str = "label"):
    """Top-k features by ANOVA F as an ML stage."""
    selector = UnivariateFeatureSelector(featuresCol=inputs, outputCol=output, labelCol=label,
                                         selectionMode="numTopFeatures")
    return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)


def slice_features(indices: Sequence[int], inputs: str = "features", output: str = "selected") -> VectorSlicer:
    return VectorSlicer(inputCol=inputs, outputCol=output, indices=[int(i) for i in sorted(indices)])


def fourier_features(columns: int = 256, gamma: float | str = "scale", inputs: str = "features",
                     output: str = "rbf", seed: int = 42) -> LearnStage:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007).

    gamma 'scale' is 1 / (d * var of all cells), 'auto' is 1 / d. The projection is one
    matrix product per Arrow batch; the matrix is drawn once from the seed.
    """
    def learn(df: DataFrame):
        width = df.select(inputs).first()[0].size
        g = gamma
        if g == "auto":
            g = 1.0 / width
        elif g == "scale":
            cells = df.select(vector_to_array(inputs).alias("a")).selectExpr(
                "aggregate(a, 0D, (s, x) -> s + x) as s1", "aggregate(a, 0D, (s, x) -> s + x * x) as s2")
            s1, s2, n = cells.agg(F.sum("s1"), F.sum("s2"), F.count(F.lit(1))).first()
            var = s2 / (n * width) - (s1 / (n * width)) ** 2
            g = 1.0 / (width * var) if var > 0 else 1.0
        rng = np.random.default_rng(seed)
        omega = rng.normal(0.0, np.sqrt(2.0 * g), (width, columns))
        phase = rng.uniform(0.0, 2.0 * np.pi, columns)

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, width))
            return pd.Series(list(np.sqrt(2.0 / columns) * np.cos(x @ omega + phase)))

        return FittedStage(
            lambda d: d.withColumn(output, array_to_vector(project(vector_to_array(inputs)))), {"gamma": g})

    return LearnStage(learn, "fourier", (columns, gamma, inputs, output, seed))

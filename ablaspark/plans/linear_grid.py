"""A whole grid of linear models from one pass over the data.

Sums of cross products per fold are enough for every (configuration, fold) pair: leave
a fold out by subtraction, solve a d x d system, and score the held-out fold from its own
sums. The pass multiplies Arrow batches inside the tasks and emits one small matrix
per partition and fold, which is summed map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q


def fold_products(df: DataFrame, columns: Sequence[str], label: str, fold: str = "fold") -> DataFrame:
    """(fold, i, j, s): sums of products of [1, columns, label], shifted by the column means."""
    names = [*columns, label]
    means = df.agg(*[F.expr(f"avg(cast({q(c)} as double))").alias(f"m{i}") for i, c in enumerate(names)]).first()
    shift = np.array([m or 0.0 for m in means])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float) - shift
            z = np.column_stack([np.ones(len(x)), x])
            folds = pdf["__fold"].to_numpy()
            for f in np.unique(folds):
                part = z[folds == f]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        for f, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"fold": int(f), "i": i.ravel(), "j": j.ravel(), "s": m.ravel()})

    data = df.select(*[F.expr(f"cast({q(c)} as double)").alias(c) for c in names],
                     F.col(q(fold)).cast("int").alias("__fold")).na.drop()
    return data.mapInPandas(multiply, "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(
        F.expr("sum(s)").alias("s"))


def linear_grid(df: DataFrame, label: str, configs: Mapping[str, Sequence[str]], fold: str = "fold",
                alpha: float = 0.0, scaled: Mapping[str, bool] | None = None) -> DataFrame:
    """(configuration, fold, n, mse, rmse, r2_score) for feature subsets of one linear model.

    ``configs`` maps a name to its columns. ``alpha`` penalises the weights, of standardised
    columns where ``scaled`` says so. Only folds x d x d sums reach the driver.
    """
    columns = sorted({c for cols in configs.values() for c in cols})
    rows = fold_products(df, columns, label, fold).collect()
    width = len(columns) + 2
    grams: dict[int, np.ndarray] = {}
    for r in rows:
        grams.setdefault(r["fold"], np.zeros((width, width)))[r["i"], r["j"]] = r["s"]
    total = sum(grams.values())
    out = []
    for name, cols in configs.items():
        pick = [0, *[columns.index(c) + 1 for c in cols]]
        y = width - 1
        for f, held in sorted(grams.items()):
            train = total - held
            n = train[0, 0]
            spread = np.ones(len(pick))
            if alpha and (scaled or {}).get(name, False):
                var = np.diag(train)[pick] / n - (train[0, pick] / n) ** 2
                spread = np.sqrt(np.where(var > 0, var, 1.0))
                spread[0] = 1.0
            a = train[np.ix_(pick, pick)] / np.outer(spread, spread)
            b = train[pick, y] / spread
            penalty = alpha * np.eye(len(pick))
            penalty[0, 0] = 0.0
            w = np.linalg.lstsq(a + penalty, b, rcond=None)[0] / spread
            m = held[0, 0]
            sse = held[y, y] - 2 * w @ held[pick, y] + w @ held[np.ix_(pick, pick)] @ w
            sst = held[y, y] - held[0, y] ** 2 / m
            mse = max(sse, 0.0) / m
            out.append((name, int(f), int(m), float(mse), float(np.sqrt(mse)), float(1 - sse / sst) if sst > 0 else 0.0))
    return df.sparkSession.createDataFrame(
        out, "configuration string, fold int, n bigint, mse double, rmse double, r2_score double")

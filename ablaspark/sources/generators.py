"""Synthetic feature tables, generated in parallel from ``spark.range``."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The named presets.
REGRESSION_PRESETS = {
    "synthetic_regression_easy": dict(n=1500, features=20, informative=10, noise=5.0, seed=101),
    "synthetic_regression_medium": dict(n=1500, features=30, informative=20, noise=15.0, seed=202),
    "synthetic_regression_hard": dict(n=1800, features=40, informative=25, noise=25.0, seed=303),
}


def regression_weights(informative: int, seed: int) -> list[float]:
    """Seeded uniform weights in [0, 100)."""
    rng = random.Random(seed)
    return [100.0 * rng.random() for _ in range(informative)]


def gen_regression(spark: SparkSession, n: int, features: int, informative: int, noise: float,
                   seed: int) -> DataFrame:
    """Standard normal features, y linear in the informative ones plus normal noise."""
    x = spark.range(n).select(
        F.col("id").alias("row_id"), *[F.randn(seed * 1009 + i).alias(f"x{i}") for i in range(features)],
        F.randn(seed * 1009 - 1).alias("__e"))
    terms = " + ".join(f"{w!r}D * x{i}" for i, w in enumerate(regression_weights(informative, seed)))
    return x.withColumn("label", F.expr(f"{terms} + {float(noise)!r}D * __e")).drop("__e")


def gen_friedman1(spark: SparkSession, n: int = 1500, features: int = 25, noise: float = 1.5,
                  seed: int = 404) -> DataFrame:
    """Friedman #1: uniform features, 10 sin(pi x0 x1) + 20 (x2 - .5)^2 + 10 x3 + 5 x4 + noise."""
    if features < 5:
        raise ValueError("five features at least")
    x = spark.range(n).select(
        F.col("id").alias("row_id"), *[F.rand(seed * 1009 + i).alias(f"x{i}") for i in range(features)],
        F.randn(seed * 1009 - 1).alias("__e"))
    y = f"10 * sin(pi() * x0 * x1) + 20 * power(x2 - 0.5D, 2) + 10 * x3 + 5 * x4 + {float(noise)!r}D * __e"
    return x.withColumn("label", F.expr(y)).drop("__e")


def gen_classification(spark: SparkSession, n: int = 1200, features: int = 25, informative: int = 18,
                       redundant: int = 4, classes: int = 4, class_sep: float = 1.3, flip: float = 0.015,
                       seed: int = 123) -> DataFrame:
    """Gaussian clusters around class centres; redundant columns are linear mixes; some labels flip."""
    rng = random.Random(seed)
    centres = [[class_sep * rng.choice((-1.0, 1.0)) for _ in range(informative)] for _ in range(classes)]
    mixes = [[rng.uniform(-1.0, 1.0) for _ in range(informative)] for _ in range(redundant)]
    raw = spark.range(n).select(
        F.col("id").alias("row_id"), F.expr(f"cast(id % {classes} as int)").alias("__c"),
        *[F.randn(seed * 1009 + i).alias(f"__e{i}") for i in range(features)],
        F.rand(seed * 1009 - 1).alias("__u"), F.rand(seed * 1009 - 2).alias("__v"))
    x = {}
    for i in range(features):
        if i < informative:
            x[f"x{i}"] = F.expr(f"__e{i} + array({', '.join(f'{c[i]!r}D' for c in centres)})[__c]")
        elif i >= informative + redundant:
            x[f"x{i}"] = F.col(f"__e{i}")
    df = raw.withColumns(x).withColumns({
        f"x{informative + j}": F.expr(" + ".join(f"{w!r}D * x{i}" for i, w in enumerate(mix)))
        for j, mix in enumerate(mixes)})
    label = f"case when __u < {flip!r}D then least(cast(floor(__v * {classes}) as int), {classes - 1}) else __c end"
    return df.withColumn("label", F.expr(label)).select("row_id", *[f"x{i}" for i in range(features)], "label")


def gen_preset(spark: SparkSession, name: str) -> DataFrame:
    if name == "synthetic_regression_nonlinear":
        return gen_friedman1(spark)
    if name == "synthetic_classification":
        return gen_classification(spark)
    if name not in REGRESSION_PRESETS:
        raise ValueError(f"unknown preset '{name}'; available: {sorted(REGRESSION_PRESETS)}")
    return gen_regression(spark, **REGRESSION_PRESETS[name])

"""Profiling: shape, gaps, class mix, task type and leakage, one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import pearson, q
from ..session import cut_lineage

_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def missing_test(df: DataFrame, column: str) -> str:
    """SQL condition: the cell is NULL, or NaN for a floating column."""
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return f"({q(column)} is null or isnan({q(column)}))"
    return f"({q(column)} is null)"


def profile_table(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, missing_cells."""
    cells = " + ".join(f"count_if({missing_test(df, c)})" for c in df.columns)
    return df.agg(F.expr("count(1)").alias("n_rows"), F.expr(cells).alias("missing_cells")).selectExpr(
        "n_rows", f"{len(df.columns)} as n_columns", "missing_cells"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first; NULL is not counted."""
    return (
        df.where(f"{q(column)} is not null").groupBy(F.col(q(column)).alias("value"))
        .agg(F.expr("count(1)").alias("n")).orderBy(F.desc("n"), "value")
    )


def dataset_info(df: DataFrame, label: str, features: Sequence[str], split: str = "split") -> DataFrame:
    """Sizes and class mix of a split table, one row per class seen in training.

    Classes are counted on the training part only. A floating label has no class mix.
    """
    if isinstance(df.schema[label].dataType, _FLOATS):
        raise ValueError(f"'{label}' is continuous; class counts need a discrete target")
    counts = df.groupBy(F.col(q(split)).alias("part"), F.col(q(label)).alias("label")).agg(
        F.expr("count(1)").alias("n"))
    counts = cut_lineage(counts)
    row = counts.agg(
        F.sum("n").alias("n_samples"),
        *[F.expr(f"coalesce(sum(n) filter (where part = '{p}'), 0)").alias(f"{p}_size") for p in ("train", "test")],
        F.expr("count(label) filter (where part = 'train')").alias("n_classes")).first()
    return counts.where("part = 'train'").selectExpr(
        f"{row['n_samples']}L as n_samples", f"{len(features)} as n_features", f"{row['n_classes']}L as n_classes",
        f"{row['train_size']}L as train_size", f"{row['test_size']}L as test_size", "label", "n",
        f"try_divide(100.0D * n, {row['train_size']}) as class_pct")


def infer_task_type(df: DataFrame, target: str, forced: str | None = None, max_classes: int = 20) -> DataFrame:
    """(target, task_type): floating or more than 20 distinct values means regression.

    A sketch settles clear cases; only a column that looks small is counted exactly, and
    then its few values collapse map-side.
    """
    if forced:
        task = forced
    elif isinstance(df.schema[target].dataType, _FLOATS):
        task = "regression"
    else:
        present = df.where(f"{q(target)} is not null")
        n = present.agg(F.approx_count_distinct(q(target))).first()[0]
        if n <= 4 * max_classes:
            n = present.agg(F.countDistinct(q(target))).first()[0]
        task = "regression" if n > max_classes else "classification"
    return df.sparkSession.createDataFrame([(target, task)], "target string, task_type string")


def label_correlations(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(column, r) for all columns from a single aggregate; NULL where r is undefined."""
    aggs = [F.expr(pearson(q(c), q(label))).alias(f"r{i}") for i, c in enumerate(columns)]
    pairs = ", ".join(f"named_struct('column', '{c}', 'r', r{i})" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(f"inline(array({pairs}))")


def leakage_check(train: DataFrame, test: DataFrame, label: str, threshold: float = 0.95) -> DataFrame:
    """Audit rows (check, column, value): time columns, |r| over the threshold, column mismatch."""
    spark = train.sparkSession
    names = [c for c in train.columns if c != label]
    found = [("time_column", c, None) for c in names if c in ("date", "timestamp")]
    other = set(test.columns) - {label}
    found += [("column_mismatch", c, None) for c in sorted(set(names) ^ other)]
    fixed = spark.createDataFrame(found, "check string, column string, value double")
    numeric = [c for c in names if isinstance(train.schema[c].dataType, (T.LongType, T.DoubleType))]
    if not numeric:
        return fixed
    strong = (
        label_correlations(train, label, numeric).where(f"abs(r) > {threshold}D")
        .selectExpr("'target_correlation' as check", "column", "abs(r) as value")
    )
    return strong.unionByName(fixed) if found else strong

"""Feature preprocessing learned on training rows and applied as projections or ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, ratio, real
from .cleaning import FittedColumns
from .ordering import column_quantiles
from .profiling import missing_test

SCALERS = ("standard", "minmax", "robust", "none")


def _num(v: float) -> str:
    return f"{float(v)!r}D"


def _one_row(df: DataFrame, parts: dict[str, str]) -> dict:
    return df.agg(*[F.expr(e).alias(k) for k, e in parts.items()]).first().asDict()


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column, ties to the smallest: one exploded count, no window."""
    pairs = ", ".join(f"named_struct('i', {i}, 'v', cast({q(c)} as string))" for i, c in enumerate(columns))
    counts = df.selectExpr(f"inline(array({pairs}))").where("v is not null").groupBy("i", "v").agg(
        F.expr("count(1)").alias("n"))
    top = counts.groupBy("i").agg(F.expr("min_by(v, struct(-n, try_cast(v as double), v))").alias("v")).collect()
    kinds = {c: t for c, t in df.dtypes}
    found = {columns[r["i"]]: r["v"] for r in top}
    return {c: v if kinds[c] == "string" else float(v) if kinds[c] in ("double", "float") else int(v)
            for c, v in found.items()}


def fit_imputer(train: DataFrame, columns: Sequence[str], strategy: str = "mean") -> FittedColumns:
    """Fill values by mean, median (exact) or most_frequent (any type)."""
    if strategy == "mean":
        fill = _one_row(train, {c: f"avg({real(q(c))})" for c in columns})
    elif strategy == "median":
        fill = {r["column"]: r["q"] for r in column_quantiles(train, columns, [0.5]).collect()}
    elif strategy == "most_frequent":
        fill = most_frequent(train, columns)
    else:
        raise ValueError("strategy must be mean, median or most_frequent")

    def literal(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else (
            _num(v) if isinstance(v, float) else repr(v))

    return FittedColumns({
        c: f"case when {missing_test(train, c)} then {literal(fill[c])} else {q(c)} end"
        for c in columns if fill.get(c) is not None
    })


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard") -> FittedColumns:
    """Scaling learned in one pass over all columns; a constant column is divided by 1.

    standard: (x - mean) / population sd; minmax: (x - min) / (max - min);
    robust: (x - median) / (q75 - q25), with exact interpolated quantiles.
    """
    if kind not in SCALERS:
        raise ValueError(f"scaler '{kind}' must be one of {SCALERS}")
    if kind == "none":
        return FittedColumns({})
    if kind == "standard":
        parts = {f"c{i}": f"avg({real(q(c))})" for i, c in enumerate(columns)}
        parts |= {f"s{i}": f"stddev_pop({real(q(c))})" for i, c in enumerate(columns)}
        row = _one_row(train, parts)
        fitted = {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    elif kind == "minmax":
        parts = {f"c{i}": f"cast(min({real(q(c))}) as double)" for i, c in enumerate(columns)}
        parts |= {f"s{i}": f"cast(max({real(q(c))}) as double)" for i, c in enumerate(columns)}
        row = _one_row(train, parts)
        fitted = {c: (row[f"c{i}"], None if row[f"c{i}"] is None else row[f"s{i}"] - row[f"c{i}"])
                  for i, c in enumerate(columns)}
    else:
        rows = column_quantiles(train, columns, [0.25, 0.5, 0.75]).collect()
        at = {(r["column"], r["p"]): r["q"] for r in rows}
        fitted = {c: (at[c, 0.5], at[c, 0.75] - at[c, 0.25]) for c in columns if (c, 0.5) in at}
    return FittedColumns({
        c: f"(cast({q(c)} as double) - {_num(mid)}) / {_num(span or 1.0)}"
        for c, (mid, span) in fitted.items() if mid is not None
    })


def anova_f_scores(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(pos, column, f_score): one-way F of every column over the label classes.

    One shuffle of per-class moments for all columns together; between-class spread is
    taken around the grand mean, so large offsets lose no digits.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = real(f"cast({q(c)} as double)")
        aggs += [F.expr(f"count({x})").alias(f"n{i}"), F.expr(f"avg({x})").alias(f"m{i}"),
                 F.expr(f"var_pop({x})").alias(f"v{i}")]
    rows = ", ".join(
        f"named_struct('pos', {i}, 'column', '{c}', 'n', n{i}, 'm', m{i}, 'v', v{i})"
        for i, c in enumerate(columns)
    )
    groups = df.groupBy(q(label)).agg(*aggs).selectExpr(f"inline(array({rows}))").where("n > 0")
    grand = groups.groupBy("pos").agg(F.expr(f"{ratio('sum(n * m)', 'sum(n)')}").alias("gm")).withColumnRenamed(
        "pos", "gpos")
    return (
        groups.join(grand, F.expr("pos = gpos")).groupBy("pos", "column")
        .agg(F.expr("sum(n * (m - gm) * (m - gm))").alias("ssb"), F.expr("sum(n * v)").alias("ssw"),
             F.expr("sum(n)").alias("n"), F.expr("count(1)").alias("k"))
        .selectExpr("pos", "column", f"{ratio(ratio('ssb', 'k - 1'), ratio('ssw', 'n - k'))} as f_score")
    )


def select_k_best(df: DataFrame, label: str, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k columns with the largest F, as (rank, column, f_score); ties keep the later column."""
    scores = anova_f_scores(df, label, columns)
    return scores.orderBy(F.desc_nulls_last("f_score"), F.desc("pos")).limit(min(k, len(columns))).selectExpr(
        "column", "pos", "f_score")


def dummy_class(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent class (ties to the smallest) and its share in training."""
    counts = train.where(f"{q(label)} is not null").groupBy(F.col(q(label)).alias("label")).agg(
        F.expr("count(1)").alias("n"))
    totals = counts.agg(F.expr("cast(sum(n) as bigint)").alias("n_train"), F.max("n").alias("top"),
                        F.expr("min_by(label, struct(-n, label))").alias("prediction"))
    return totals.selectExpr("prediction", "n_train", "top as n_class")


def predict_constant(df: DataFrame, fitted: DataFrame, column: str = "prediction") -> DataFrame:
    """Attach the single fitted value to every row as a literal."""
    row = fitted.first()
    return df.withColumn(column, F.lit(row[column]))

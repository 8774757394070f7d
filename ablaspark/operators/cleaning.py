"""Row and cell repairs: missing rows, infinities, medians, encodings, products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q
from ..session import cut_lineage, small_side
from .ordering import column_quantiles, ordered_rank
from .profiling import missing_test

MAX_DOUBLE = "1.7976931348623157E308D"


@dataclass(frozen=True)
class FittedColumns:
    """Column expressions learned on one table, applied to any table as a projection."""

    exprs: Mapping[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in self.exprs.items()})


def drop_missing_rows(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Keep rows with every feature, and then the target, present (NaN counts as missing)."""
    for c in [*features, *([target] if target else [])]:
        df = df.where(f"not {missing_test(df, c)}")
    return df


def cap_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+-inf becomes the largest finite double. Missing cells turn to 0 only if any inf exists."""
    any_inf = " or ".join(f"abs({q(c)}) = double('Infinity')" for c in columns)
    has_inf = not df.where(any_inf).select(F.lit(1)).limit(1).isEmpty()
    if not has_inf:
        return df
    capped = {
        c: F.expr(
            f"case when {q(c)} = double('Infinity') then {MAX_DOUBLE}"
            f" when {q(c)} = double('-Infinity') then -{MAX_DOUBLE}"
            f" when {q(c)} is null or isnan({q(c)}) then 0.0D else {q(c)} end")
        for c in columns
    }
    return df.withColumns(capped)


def fit_fill_median(df: DataFrame, columns: Sequence[str]) -> FittedColumns:
    """Exact column medians; fit on the training rows to keep test rows out of them."""
    medians = {r["column"]: r["q"] for r in column_quantiles(df, columns, [0.5]).collect()}
    return FittedColumns({
        c: f"case when {missing_test(df, c)} then {medians[c]!r}D else cast({q(c)} as double) end"
        for c in columns if c in medians
    })


def fill_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fit_fill_median(fit_on if fit_on is not None else df, columns).transform(df)


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based rank among the sorted distinct texts; NULL is the text 'nan'.

    Distinct values are ranked bucket-wise, so the dictionary may be larger than any task.
    """
    texts = df.selectExpr(f"coalesce(cast({q(column)} as string), 'nan') as value").distinct()
    return ordered_rank(cut_lineage(texts), ["value"], "code").selectExpr("value", "code - 1 as code")


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Replace a text column by its dictionary code (or add it under ``out``).

    The dictionary is written once and counted: a small one is broadcast, a large one shuffled.
    """
    name = out or column
    codes = small_side(cut_lineage(label_dictionary(df, column))).withColumnsRenamed(
        {"value": "__value", "code": "__code"})
    keyed = df.withColumn("__text", F.expr(f"coalesce(cast({q(column)} as string), 'nan')"))
    joined = keyed.join(codes, F.col("__text") == F.col("__value"), "left")
    return joined.withColumn(name, F.col("__code")).drop("__text", "__value", "__code")


def interaction_terms(df: DataFrame, products: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``a * b`` under each name, only where both inputs exist."""
    present = {n: (a, b) for n, (a, b) in products.items() if a in df.columns and b in df.columns}
    return df.withColumns({n: F.expr(f"{q(a)} * {q(b)}") for n, (a, b) in present.items()})


# Fixed value: the product columns of the churn study.
CHURN_PRODUCTS = {
    "service_calls_x_day_charge": ("Customer service calls", "Total day charge"),
    "intl_plan_x_charge": ("International plan", "Total intl charge"),
}


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop id or target columns; names that are absent are an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} not found; available: {df.columns}")
    return df.drop(*columns)


def keep_successes(df: DataFrame, success: str | None = None, status: str | None = None,
                   metric: str | None = None) -> DataFrame:
    """Rows that succeeded: a missing flag counts as success, a missing metric does not."""
    if status:
        df = df.where(f"{q(status)} = 'success'")
    if success:
        df = df.where(f"coalesce({q(success)}, true)")
    if metric:
        df = df.where(f"not {missing_test(df, metric)}")
    return df


def keep_n_runs(df: DataFrame, n_runs: int = 20) -> DataFrame:
    return df.where(f"n_runs = {int(n_runs)}")


def results_table(df: DataFrame, digits: int | None = None) -> DataFrame:
    """The eight-column result table with accuracy names; optionally rounded for print."""
    def shown(c: str) -> str:
        return f"round({c}, {digits})" if digits is not None else c

    return df.selectExpr(
        "dataset", "variant", "configuration", f"{shown('mean')} as accuracy_mean",
        f"{shown('std')} as accuracy_std", "n_runs", f"{shown('ci_lower')} as ci_lower",
        f"{shown('ci_upper')} as ci_upper",
    )

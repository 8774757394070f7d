"""Null-safe arithmetic as SQL text. ANSI mode raises on x/0; here a missing result is NULL.

All helpers take and return SQL fragments (column names or expressions) for use in
``selectExpr``, ``F.expr`` and ``agg``; Catalyst parses each of them once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def ratio(num: str, den: str) -> str:
    """num / den as double, NULL when den is 0 or either side is NULL."""
    return f"try_divide(cast({num} as double), cast({den} as double))"


def ratio0(num: str, den: str) -> str:
    """num / den, 0.0 where undefined (the zero-division rule of the class metrics)."""
    return f"coalesce({ratio(num, den)}, 0.0D)"


def real(c: str) -> str:
    """NaN read as NULL, for double and float columns."""
    return f"nullif({c}, double('NaN'))"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row under ``name`` and use it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pearson(x: str, y: str) -> str:
    """Aggregate: Pearson r; NULL if either side is constant or any value is missing."""
    x, y = f"cast({x} as double)", f"cast({y} as double)"
    gap = f"count_if({x} is null or {y} is null or isnan({x}) or isnan({y})) = 0"
    r = f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"
    return f"case when {gap} then {r} end"


def expr(text: str, alias: str | None = None) -> Column:
    column = F.expr(text)
    return column.alias(alias) if alias else column

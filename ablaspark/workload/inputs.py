"""Stand-in tables derived from the driver's data, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables
from .sqltext import CONFIG_CASE, ORDER_CASE


def runs(t: Tables) -> DataFrame:
    """Run results: one score per (experiment, configuration, run), from lineitem."""
    return t.lineitem.selectExpr(
        "cast(l_suppkey % 10 as int) as experiment", f"{CONFIG_CASE} as configuration", f"{ORDER_CASE} as cfg_ord",
        "cast(l_linenumber as int) as run", "l_discount", "l_quantity",
    ).groupBy("experiment", "configuration", "cfg_ord", "run").agg(
        F.expr("avg(l_discount)").alias("value"), F.expr("avg(l_quantity)").alias("qty"))


def lines(t: Tables) -> DataFrame:
    """lineitem with the whole quantity as fifth id column."""
    return t.lineitem.withColumn("__q", F.expr("cast(l_quantity as bigint)"))

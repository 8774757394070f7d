"""Query registry: one output spec shapes both the Spark result and the check SQL.

A spec lists the columns with a kind: ``f`` rounds to 6 places (``f4`` to 4), ``i`` is a
bigint, ``a`` joins an array with '|', no kind passes the column through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy readers of one data folder: ``t.lineitem`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _shape(spec: str, spark: bool) -> str:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        name = f"`{name}`" if spark else f'"{name}"'
        if kind.startswith("f"):
            out.append(f"round({name}, {kind[1:] or 6}) + 0.0{'D' if spark else 'e0'} as {name}")
        elif kind == "i":
            out.append(f"cast({name} as bigint) as {name}")
        elif kind == "a":
            out.append(f"{'array_join' if spark else 'array_to_string'}({name}, '|') as {name}")
        elif kind == "s":
            out.append(f"cast({name} as {'string' if spark else 'varchar'}) as {name}")
        else:
            out.append(name)
    return out


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir)).selectExpr(*_shape(spec, True))

        shaped = None
        if sql:
            shaped = f"SELECT {', '.join(_shape(spec, False))} FROM ({sql.strip()}) AS result"
        REGISTRY[name] = Query(name, run, shaped)
        return fn

    return wrap

"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation (combined map-side) and a join whose hot keys AQE splits; the result
of a round is written to the shared folder, so lineage stays short. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame, key: str, value: str) -> DataFrame:
    return stored(edges.groupBy(key).agg(F.min(value).alias("least")), "star-least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of its component.

    Rows with a null end and loops are ignored, repeated edges are harmless, no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(f"{a} is not null and {b} is not null")
    now = stored(now.filter("a > b").distinct(), "star")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = mark
        # large star: greater neighbours of a node move to the node's least neighbour (or itself)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_least(both, "u", "v"), "u").filter("v > u").select(
            F.col("v").alias("a"), F.least("u", "least").alias("b")).distinct()
        large = stored(large, "star-large")
        # small star: lesser neighbours of a node, and the node, move to the least of them
        least = _least(large, "a", "b")
        moved = large.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = stored(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "star")

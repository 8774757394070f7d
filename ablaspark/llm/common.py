"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: ASCII white space and words of the query contracts (Java and RE2 spelling).
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    It cuts lineage: later branches read the same rows, and a lost executor costs only tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """row (a struct of all columns), row_no and ``columns``. Written, since row numbers change when rows are read anew."""
    return stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no"), *columns), "numbered")


def one_of_each(held: DataFrame, groups: DataFrame, doc_id: str) -> DataFrame:
    """Of the numbered rows those without a group, and of each group (row_no, root) the row with the smallest id.

    Null ids come last; of rows that tie, the smallest row number stays.
    """
    ids = stored(held.select("row_no", F.col("row")[doc_id].cast("bigint").alias("id")).join(groups, "row_no"), "groups")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row_no")
    first = ids.groupBy("root").agg(F.min(rank)["row_no"].alias("stays"))
    gone = stored(ids.join(first, "root").filter("row_no <> stays").select("row_no"), "copies")
    return held.join(gone, "row_no", "left_anti").select("row.*")


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least ``n``, held within [least, most]."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def offsets(totals: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive running total of a small table of bucket totals."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, order, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))

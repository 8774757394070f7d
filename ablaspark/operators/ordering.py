"""Exact ranks, prefix sums and quantiles without a single hot task.

A window over one global (or one skewed) group would put that whole group in one
task. Here the rows are range-partitioned by group and order, which is written once;
per-range totals are prefix-summed (a small table), and only rows of one range ever
share a task. The number of ranges is that of the shuffle partitions, so it follows the
data like any other shuffle. Keys keep their own types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import q
from ..session import cut_lineage, small_side


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the right copies of the keys go away."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(q(k)).eqNullSafe(F.col(q(f"__r_{k}")))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def prefix_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``before_<x>``: the sum of x over rows of the same ``by`` group with a smaller key.

    The order expressions must tell the rows of a group apart (aggregate ties first,
    or end the order with a unique id); nulls come first.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    cut = df.selectExpr("*", *[f"{o} as {k}" for o, k in zip(order, keys)]).repartitionByRange(
        *[F.col(q(b)) for b in by], *keys).withColumn("__b", F.spark_partition_id())
    # Written once: the ranges must be the same for the totals and for the rows.
    cut = cut_lineage(cut)
    # One struct key for window and join: NULL groups match, and both use a single shuffle.
    cut = cut.withColumn("__g", F.struct(*[F.col(q(b)) for b in by], "__b"))
    totals = cut.groupBy("__g").agg(*[F.expr(f"sum({q(s)})").alias(f"__t_{s}") for s in sums])
    over = Window.partitionBy(*[f"__g.{q(b)}" for b in by]) if by else Window.partitionBy(F.lit(1))
    earlier = over.orderBy("__g.__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__g", *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__p_{s}") for s in sums])
    inside = Window.partitionBy("__g").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.select("*", *[F.coalesce(F.sum(q(s)).over(inside), F.lit(0)).alias(f"__w_{s}") for s in sums])
    return within.join(starts, "__g").select(
        *[q(c) for c in df.columns],
        *[(F.col(f"__p_{s}") + F.col(f"__w_{s}")).alias(f"before_{s}") for s in sums],
    )


def ordered_rank(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based position of each row within ``by`` under a total order."""
    ranked = prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"], by)
    return ranked.withColumn(name, F.col("before___one") + 1).drop("__one", "before___one")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = 10_000, bins: int = 1024) -> DataFrame:
    """Linear-interpolated quantiles, exact at any size: rows ``(by..., p, q)``.

    A sketch per group (mergeable, bounded) brackets each wanted rank within a few
    parts in ``accuracy``. One pass then counts what lies below and in equal-width
    bins of the bracket, and a second pass ranks only the bins that hold the wanted
    ranks. Groups no larger than ``accuracy`` use their full range as the bracket.
    """
    by = list(by) or ["__all"]
    base = df.selectExpr(
        *([q(b) for b in by] if by != ["__all"] else ["1 as __all"]), f"cast({value} as double) as __v"
    ).where("__v is not null and not isnan(__v)")
    # Read by every pass below.
    base = cut_lineage(base)
    margin = 4.0 / accuracy
    asked = ", ".join(f"{max(0.0, p - margin)!r}D, {min(1.0, p + margin)!r}D" for p in probs)
    targets = []
    for i, p in enumerate(probs):
        lo = "__min" if p <= margin else f"case when __n <= {accuracy} then __min else __s[{2 * i}] end"
        hi = "__max" if p >= 1 - margin else f"case when __n <= {accuracy} then __max else __s[{2 * i + 1}] end"
        targets.append(f"named_struct('p', {float(p)!r}D, 'lo', {lo}, 'hi', {hi}, 'n', __n)")
    brackets = cut_lineage(
        base.groupBy(*by)
        .agg(F.expr("count(1)").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
             F.expr(f"percentile_approx(__v, array({asked}), {accuracy})").alias("__s"))
        .selectExpr(*[q(b) for b in by], f"array({', '.join(targets)}) as __targets")
    )
    binned = (
        null_safe_join(base, small_side(brackets), by)
        .selectExpr(*[q(b) for b in by], "__v", "inline(__targets)")
        .where("__v <= hi")
        .selectExpr(
            *[q(b) for b in by], "p", "n", "__v",
            "case when __v < lo then -1 "
            f"when hi - lo > 0 and hi - lo < double('Infinity') then least(cast((__v - lo) / (hi - lo) * {bins} as int), {bins - 1}) "
            "else 0 end as __bin",
        )
    )
    key = [*by, "p"]
    order = Window.partitionBy(*key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        binned.groupBy(*key, "n", "__bin").agg(F.expr("count(1)").alias("__c"))
        .withColumn("__cum", F.sum("__c").over(order))
        .selectExpr(*[q(k) for k in key], "__bin", "__cum - __c as __before", "__cum",
                    "cast(floor(p * (n - 1)) as bigint) as __r0", "cast(ceil(p * (n - 1)) as bigint) as __r1",
                    "p * (n - 1) - floor(p * (n - 1)) as __frac")
        .where("(__before <= __r0 and __r0 < __cum) or (__before <= __r1 and __r1 < __cum)")
    )
    wanted = small_side(cut_lineage(wanted.drop("__cum")))
    inside = Window.partitionBy(*key, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    marks = ["__before", "__r0", "__r1", "__frac"]
    ranked = (
        null_safe_join(binned, wanted, [*key, "__bin"])
        .groupBy(*key, "__bin", *marks, "__v").agg(F.expr("count(1)").alias("__c"))
        .withColumn("__to", F.col("__before") + F.sum("__c").over(inside))
    )
    missed = "cast(raise_error('quantile bracket missed its rank') as double)"
    out = ranked.groupBy(*key).agg(
        F.expr("max(case when __to - __c <= __r0 and __r0 < __to then __v end)").alias("__v0"),
        F.expr("max(case when __to - __c <= __r1 and __r1 < __to then __v end)").alias("__v1"),
        F.max("__frac").alias("__frac"),
    )
    return out.selectExpr(
        *[q(b) for b in by if b != "__all"], "p",
        "case when __v0 = __v1 then __v0 else coalesce(__v0, " + missed + ") + (coalesce(__v1, " + missed
        + ") - __v0) * __frac end as q",
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of many numeric columns in the same few passes: ``(column, p, q)``."""
    pairs = ", ".join(f"named_struct('column', '{c}', 'value', cast({q(c)} as double))" for c in columns)
    return exact_quantiles(df.selectExpr(f"inline(array({pairs}))"), "value", probs, by=["column"])

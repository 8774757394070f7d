"""Exact random splits and folds that never sort or shuffle the table itself.

Every row gets the order key ``md5(id|seed)``. Only the *cut keys* between parts are
needed: count rows per key prefix, find the prefixes where the wanted ranks fall, and
rank inside those few prefixes. Assigning a part is then a comparison per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import let, q
from ..session import cut_lineage, small_side

_DIGITS = 3             # hex digits of the key looked at per round
_ONE_TASK = 2_000_000   # a prefix with more rows than this is cut finer before it is sorted
_ONE = "'all'"


def order_key(ids: Sequence[str], seed: int) -> str:
    """SQL of the order key. The id columns together must be unique."""
    parts = ", ".join(f"cast({q(c)} as string)" for c in ids)
    return f"md5(concat_ws('|', {parts}, '{int(seed)}'))"


def _class_of(label: str | None) -> str:
    return _ONE if label is None else f"coalesce(cast({q(label)} as string), '\\0')"


def _keyed(df: DataFrame, ids: Sequence[str], seed: int, label: str | None, digits: int) -> DataFrame:
    """(cls, key, pre, parent): all a cut needs, two columns wide."""
    return df.selectExpr(f"{_class_of(label)} as cls", f"{order_key(ids, seed)} as key").selectExpr(
        "cls", "key", f"substring(key, 1, {digits}) as pre", f"substring(key, 1, {digits - _DIGITS}) as parent")


def _cut_keys(df: DataFrame, ids: Sequence[str], seed: int, label: str | None, ranks) -> DataFrame:
    """(cls, cuts): sorted order keys at the wanted 1-based ranks of each class.

    ``ranks`` maps the class table (cls, n) to rows (cls, rank). Counting rows per key prefix
    tells which prefixes hold the ranks; a prefix that is still too large for one task is
    counted again three digits deeper.
    """
    digits, targets, wanted = _DIGITS, None, None
    while True:
        keyed = _keyed(df, ids, seed, label, digits)
        if targets is not None:
            keyed = keyed.join(small_side(targets.selectExpr("cls", "pre as parent").distinct()),
                               ["cls", "parent"], "left_semi")
        counts = cut_lineage(keyed.groupBy("cls", "parent", "pre").agg(F.expr("count(1)").alias("c")))
        if targets is None:
            classes = counts.groupBy("cls").agg(F.expr("cast(sum(c) as bigint)").alias("n"))
            wanted = cut_lineage(ranks(classes))
            targets = wanted.where("rank > 0").selectExpr("cls", "'' as pre", "rank")
        up_to = Window.partitionBy("cls", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
        spans = counts.withColumn("cum", F.sum("c").over(up_to))
        asked = targets.selectExpr("cls as t_cls", "pre as t_pre", "rank")
        targets = cut_lineage(
            spans.join(asked, F.expr("cls = t_cls and parent = t_pre and cum - c < rank and rank <= cum"))
            .selectExpr("cls", "pre", "rank - (cum - c) as rank", "c"))
        if (targets.agg(F.max("c")).first()[0] or 0) <= _ONE_TASK or digits + _DIGITS > 32:
            break
        digits += _DIGITS
    inside = Window.partitionBy("cls", "pre").orderBy("key")
    ranked = (
        _keyed(df, ids, seed, label, digits)
        .join(small_side(targets.select("cls", "pre").distinct()), ["cls", "pre"], "left_semi")
        .withColumn("rank", F.row_number().over(inside))
    )
    # A cut at rank 0 lies below every key. Equal ranks (an empty part) keep both cuts.
    found = ranked.join(small_side(targets.drop("c")), ["cls", "pre", "rank"]).select("cls", "key")
    lowest = wanted.where("rank = 0").selectExpr("cls", "'' as key")
    return found.union(lowest).groupBy("cls").agg(F.sort_array(F.collect_list("key")).alias("cuts"))


def _place(df: DataFrame, cuts: DataFrame, ids: Sequence[str], seed: int, label: str | None,
           value: str, name: str) -> DataFrame:
    """Add ``value`` (SQL over ``part``, the number of cuts below the key) as column ``name``."""
    named = cut_lineage(cuts).withColumnsRenamed({"cls": "__cls", "cuts": "__cuts"})
    part = let("k", order_key(ids, seed), "size(filter(__cuts, c -> k > c))")
    placed = df.join(small_side(named), F.expr(f"{_class_of(label)} = __cls"), "left").drop("__cls")
    placed = placed.withColumn("__cuts", F.expr("coalesce(__cuts, cast(array() as array<string>))"))
    return placed.withColumn(name, F.expr(value.format(part=part))).drop("__cuts")


def _test_quota(test_size: float):
    """Per-class test sizes: ceil(n * test_size) rows in all, by largest remainder."""
    def ranks(classes: DataFrame) -> DataFrame:
        # One row per class; the window only ever holds the class table.
        every = Window.partitionBy(F.lit(1))
        share = (
            classes.withColumn("total", F.sum("n").over(every))
            .selectExpr("cls", "n", f"cast(ceil(total * {test_size!r}D) as bigint) as n_test", "total")
            .selectExpr("cls", "n_test", "n * n_test div total as base", "n * n_test % total as rest")
            .withColumn("spare", F.expr("n_test") - F.sum("base").over(every))
        )
        turn = every.orderBy(F.desc("rest"), "cls")
        return share.withColumn("turn", F.row_number().over(turn)).selectExpr(
            "cls", "base + case when turn <= spare then 1 else 0 end as rank")

    return ranks


def split_holdout(df: DataFrame, ids: Sequence[str], test_size: float = 0.2, seed: int = 42,
                  name: str = "split") -> DataFrame:
    """Random split: exactly ceil(n * test_size) rows are 'test', the others 'train'."""
    return split_stratified(df, ids, None, test_size, seed, name)


def split_stratified(df: DataFrame, ids: Sequence[str], label: str | None, test_size: float = 0.2,
                     seed: int = 42, name: str = "split") -> DataFrame:
    """The same with class proportions kept (largest remainder, ties to the smaller label)."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    cuts = _cut_keys(df, ids, seed, label, _test_quota(test_size))
    return _place(df, cuts, ids, seed, label, "case when {part} > 0 then 'train' else 'test' end", name)


def kfold(df: DataFrame, ids: Sequence[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1; the first n % k folds hold one row more."""
    def ranks(classes: DataFrame) -> DataFrame:
        return classes.selectExpr("cls", "n", f"explode(sequence(1, {k - 1})) as i").selectExpr(
            "cls", f"i * (n div {k}) + least(i, n % {k}) as rank")

    cuts = _fold_cuts(df, ids, k, seed, None, ranks)
    return _place(df, cuts, ids, seed, None, "{part}", name)


def stratified_kfold(df: DataFrame, ids: Sequence[str], label: str, k: int = 5, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """Folds with the class mix kept and overall sizes that differ by at most one.

    Lay the classes end to end in label order; fold i owns the positions congruent to
    i mod k. That gives every class its fold sizes, and within a class the folds are
    runs of the hash order.
    """
    def ranks(classes: DataFrame) -> DataFrame:
        before = Window.partitionBy(F.lit(1)).orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
        # positions s .. s+n-1; how many are congruent to i mod k
        at = f"(floor((s + n - 1 - j) / {k}) - floor((s - 1 - j) / {k}))"
        return (
            classes.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .selectExpr("cls", "n", "s", f"explode(sequence(1, {k - 1})) as i")
            .selectExpr("cls", f"cast(aggregate(sequence(0, i - 1), 0L, (t, j) -> t + {at}) as bigint) as rank")
        )

    cuts = _fold_cuts(df, ids, k, seed, label, ranks)
    return _place(df, cuts, ids, seed, label, "{part}", name)


def _fold_cuts(df, ids, k, seed, label, ranks) -> DataFrame:
    if k < 2:
        raise ValueError("k must be at least 2")
    return _cut_keys(df, ids, seed, label, ranks)


def seed_schedule(df: DataFrame, repeats: int, base_seed: int = 42, first_run: int = 1) -> DataFrame:
    """Each row once per repeat, with ``run`` (1- or 0-based) and ``random_state = base + i``."""
    return df.selectExpr("*", f"explode(sequence(0, {int(repeats) - 1})) as __i").selectExpr(
        *[q(c) for c in df.columns], f"__i + {int(first_run)} as run", f"__i + {int(base_seed)} as random_state"
    )


def head_cap(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows under a fixed order, for smoke fits; an empty result is an error."""
    capped = df.orderBy(*order).limit(int(n))
    if capped.isEmpty():
        raise ValueError("no rows left after capping")
    return capped

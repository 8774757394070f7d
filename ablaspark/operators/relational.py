"""The remaining relational shapes: lookups with defaults, unions, set differences, log tails."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q


def join_metadata(df: DataFrame, metadata: DataFrame, key: str, column: str, default: str = "unknown") -> DataFrame:
    """Left lookup with a default. The metadata side is broadcast only if it measures small."""
    m = metadata.selectExpr(f"{q(key)} as __key", f"{q(column)} as __value")
    return df.join(m, F.expr(f"{q(key)} = __key"), "left").withColumn(
        column, F.expr(f"coalesce(__value, '{default}')")).drop("__key", "__value")


def apply_defaults(experiments: DataFrame, defaults: Mapping, enabled: str = "enabled") -> DataFrame:
    """Enabled manifest rows, with missing settings taken from the global record."""
    rows = experiments.where(f"coalesce({q(enabled)}, false)")
    return rows.withColumns({c: F.coalesce(F.col(q(c)), F.lit(v)) for c, v in defaults.items()})


def union_frames(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Concatenate by name; absent columns are NULL; each row carries the name of its frame."""
    tagged = [d.select(F.lit(n).alias(tag), "*") for n, d in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def column_differences(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns present on one side only."""
    return sorted(set(left.columns) ^ set(right.columns))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symmetric multiset difference of two tables, each row tagged with its side.

    One counted shuffle of the distinct rows, rather than two exceptAll passes.
    """
    cols = left.columns
    both = left.select("*", F.lit(1).alias("__d")).unionByName(right.select("*", F.lit(-1).alias("__d")))
    net = both.groupBy(*cols).agg(F.sum("__d").alias("__d")).where("__d != 0")
    return net.selectExpr(*[q(c) for c in cols], "if(__d > 0, 'left', 'right') as side", "abs(__d) as n")


def newest_log(logs: DataFrame, task: str, file: str, text: str) -> DataFrame:
    """(task, file, text) of the last file name per task."""
    return logs.groupBy(q(task)).agg(
        F.expr(f"max({q(file)})").alias("file"), F.expr(f"max_by({q(text)}, {q(file)})").alias("text"))


def log_tail(logs: DataFrame, task: str, file: str, text: str, n: int = 30) -> DataFrame:
    """Last n lines of the newest log per task; a closing line break adds no line."""
    lines = r"split(regexp_replace(text, '\n$', ''), '\n')"
    return newest_log(logs, task, file, text).selectExpr(
        q(task), "file", f"array_join(slice({lines}, greatest(1, size({lines}) - {n - 1}), {n}), '\\n') as tail")


def token_presence(df: DataFrame, text: str, required: Mapping[str, str], optional: Mapping[str, str]) -> DataFrame:
    """Add missing_required and found_optional: names whose token is absent / present in the text.

    The token tables are constants, so the semi and anti joins against them are plain filters.
    """
    def names(tokens: Mapping[str, str], test: str) -> str:
        tests = ", ".join(f"case when {test.format(token=t)} then '{n}' end" for n, t in tokens.items())
        return f"filter(array({tests}), x -> x is not null)"

    return df.withColumns({
        "missing_required": F.expr(names(required, f"not contains({q(text)}, '{{token}}')")),
        "found_optional": F.expr(names(optional, f"contains({q(text)}, '{{token}}')")),
    })


# Step tokens looked for in generated sources.
REQUIRED_TOKENS = {"preprocessor": "preprocessor", "feature_engineering": "feature_engineering", "model": "model"}
OPTIONAL_TOKENS = {
    "tuning": "GridSearchCV", "tuning2": "RandomizedSearchCV", "ensemble_voting": "VotingClassifier",
    "ensemble_stacking": "StackingClassifier", "ensemble_bagging": "BaggingClassifier",
}



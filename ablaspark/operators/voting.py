"""Combining model outputs that sit side by side in one row: no joins, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import let, q


def vote_hard(df: DataFrame, predictions: Sequence[str], name: str = "vote") -> DataFrame:
    """Majority class of the member predictions; ties go to the smallest class."""
    # The votes are bound first: inside a lambda a column could hide behind a variable name.
    tally = let("__votes", f"array({', '.join(q(p) for p in predictions)})", (
        "array_min(transform(array_distinct(__votes),"
        " __c -> named_struct('less', -size(filter(__votes, __v -> __v = __c)), 'cls', __c))).cls"))
    return df.withColumn(name, F.expr(tally))


def member_weights(scores: Sequence[float], floor: float = 0.2) -> list[float | None]:
    """Soft-vote weights: F1 squared; members at or below ``floor`` are left out (None)."""
    return [s * s if s is not None and s > floor else None for s in scores]


def vote_soft(df: DataFrame, probabilities: Sequence[Sequence[str]], classes: Sequence,
              weights: Sequence[float | None] | None = None, name: str = "vote") -> DataFrame:
    """Weighted mean of class probabilities and the arg-max class (first class on ties).

    ``probabilities[m][c]`` is the column of member m for class c. With no member left
    the vote is NULL (the caller scores it 0).
    """
    use = list(weights) if weights is not None else [1.0] * len(probabilities)
    kept = [(m, w) for m, w in zip(probabilities, use) if w is not None]
    total = sum(w for _, w in kept)
    if not kept or total == 0:
        return df.withColumns({name: F.lit(None).cast("string"), f"{name}_proba": F.lit(None).cast("array<double>")})
    means = [
        "(" + " + ".join(f"{float(w)!r}D * {q(m[i])}" for m, w in kept) + f") / {float(total)!r}D"
        for i in range(len(classes))
    ]
    proba = f"array({', '.join(means)})"
    values = ", ".join(f"'{c}'" if isinstance(c, str) else f"{c!r}D" if isinstance(c, float) else repr(c) for c in classes)
    out = df.withColumn(f"{name}_proba", F.expr(proba))
    best = f"array_position({name}_proba, array_max({name}_proba))"
    return out.withColumn(name, F.expr(f"element_at(array({values}), cast({best} as int))"))


def vote_regressor(df: DataFrame, predictions: Sequence[str], name: str = "vote") -> DataFrame:
    """Plain mean of the member predictions."""
    return df.withColumn(name, F.expr(f"({' + '.join(q(p) for p in predictions)}) / {len(predictions)}.0D"))


def best_ensemble(scores: DataFrame, voting: str = "voting_score", weighted: str = "weighted_score") -> DataFrame:
    """Take the weighted vote only where it is strictly better; a missing weighted score is 0."""
    w = f"coalesce({q(weighted)}, 0.0D)"
    return scores.selectExpr(
        "*", f"case when {w} > {q(voting)} then 'weighted_ensemble' else 'voting_ensemble' end as best_ensemble",
        f"greatest({w}, {q(voting)}) as best_score",
    )

"""The statistical report: summary, ANOVA and pairwise tables over one runs table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.hypothesis import anova_test, pairwise_comparison
from ..operators.summaries import summarize_statistics


def statistical_report(runs: DataFrame, by: Sequence[str], order: str | None = None,
                       alpha: float = 0.05) -> dict[str, DataFrame]:
    """summary always; anova over experiments with more than two configurations; pairwise over those with two.

    ``runs`` is (by..., configuration, run, value). The three tables share it: persist it
    if it is costly. Experiments with too few configurations simply have no rows.
    """
    anova = anova_test(runs, "value", "configuration", by, alpha)
    return {
        "summary": summarize_statistics(runs, "value", [*by, "configuration"]),
        "anova": anova.where("n_groups > 2"),
        "pairwise": pairwise_comparison(runs, by, order=order, alpha=alpha),
    }

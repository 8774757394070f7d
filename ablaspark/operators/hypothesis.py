"""Statistical tests, all grouped: one row of moments per group, then expressions.

Only the paired forms join anything, and they join aggregated run scores. A statistic
that a zero spread makes infinite has p = 0; one that is undefined is NULL and never
counts as significant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import q, ratio, real
from ..functions.tails import f_sf, norm_upper_ppf, t_two_sided
from ..session import cut_lineage, small_side
from .summaries import t_quantiles


def guarded_ratio(num: str, den: str) -> str:
    """num / den; a zero denominator gives signed infinity, or NULL for 0 / 0."""
    return (f"case when {den} = 0 and {num} != 0 then sign({num}) * double('Infinity')"
            f" else try_divide({num}, {den}) end")


def t_p_value(t: str, df: str) -> str:
    """Two-sided p of a t that may be infinite (then 0)."""
    return f"case when abs({t}) = double('Infinity') then 0.0D else {t_two_sided(t, df)} end"


def f_p_value(f: str, d1: str, d2: str) -> str:
    return f"case when {f} = double('Infinity') then 0.0D else {f_sf(f, d1, d2)} end"


def significant(p: str, alpha: str) -> str:
    return f"coalesce({p} < {alpha}, false)"


def t_to_z(t: str, p: str) -> str:
    """sign(t) times the normal quantile of the same two-sided p; p/2 clipped to [1e-12, .5]."""
    tail = f"least(greatest({p} / 2, 1e-12D), 0.5D)"
    return f"case when {t} is not null and {p} is not null then sign({t}) * ({norm_upper_ppf(tail)}) end"


def pooled_d(mean_a: str, std_a: str, n_a: str, mean_b: str, std_b: str, n_b: str) -> str:
    """Cohen's d with pooled standard deviation; 0 where the pooled spread is 0."""
    pooled = (f"sqrt(try_divide(({n_a} - 1) * {std_a} * {std_a} + ({n_b} - 1) * {std_b} * {std_b},"
              f" cast({n_a} + {n_b} - 2 as double)))")
    return f"case when {pooled} = 0 then 0.0D else try_divide({mean_a} - {mean_b}, {pooled}) end"


def with_d_interval(effects: DataFrame, d: str, n1: str, n2: str, alpha: float = 0.05) -> DataFrame:
    """Add d_ci_lower/upper: d -+ t * sqrt((n1+n2)/(n1*n2) + d^2 / (2(n1+n2))), df = n1 + n2 - 2 (looked up per distinct df)."""
    half = f"__t * sqrt(({n1} + {n2}) / cast({n1} * {n2} as double) + {d} * {d} / (2.0D * ({n1} + {n2})))"
    return t_quantiles(effects, f"{n1} + {n2} - 2", alpha / 2).withColumn("__half", F.expr(half)).selectExpr(
        *[q(c) for c in effects.columns], f"{d} - __half as d_ci_lower", f"{d} + __half as d_ci_upper")


def effect_label(d: str, title: bool = False) -> str:
    """negligible < .2 <= small < .5 <= medium < .8 <= large, on |d|."""
    names = ["negligible", "small", "medium", "large"]
    a, b, c, e = (n.title() for n in names) if title else names
    return (f"case when abs({d}) < 0.2D then '{a}' when abs({d}) < 0.5D then '{b}'"
            f" when abs({d}) < 0.8D then '{c}' when {d} is not null then '{e}' end")


def p_stars(p: str) -> str:
    """*** < .001, ** < .01, * < .05, ns; a missing p is a dash."""
    return (f"case when {p} is null or isnan({p}) then '—' when {p} < 0.001D then '***'"
            f" when {p} < 0.01D then '**' when {p} < 0.05D then '*' else 'ns' end")


def pair_runs(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Inner equi-join of two score tables on the run keys: (on..., a, b)."""
    left = a.selectExpr(*[q(k) for k in on], f"{real(q(value))} as a")
    return left.join(b.selectExpr(*[q(k) for k in on], f"{real(q(value))} as b"), list(on))


def paired_t_test(pairs: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Paired test over (a, b) rows: t_statistic, p_value, significant, mean_diff."""
    m = pairs.groupBy(*by).agg(
        F.expr("count(a - b)").alias("n"), F.expr("avg(a - b)").alias("md"),
        F.expr("stddev_samp(a - b)").alias("sd"), F.expr("avg(a) - avg(b)").alias("mean_diff"))
    t = m.withColumn("t_statistic", F.expr(guarded_ratio("md", "(sd / sqrt(n))")))
    p = t.withColumn("p_value", F.expr(t_p_value("t_statistic", "(n - 1)")))
    return p.selectExpr(*[q(b) for b in by], "t_statistic", "p_value",
                        f"{significant('p_value', f'{alpha!r}D')} as significant", "mean_diff", "n")


def group_moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., n, mean, var) with population variance; partial sums combine map-side."""
    x = real(f"cast({q(value)} as double)")
    return df.groupBy(*by).agg(F.expr(f"count({x})").alias("n"), F.expr(f"avg({x})").alias("mean"),
                               F.expr(f"var_pop({x})").alias("var"))


def independent_t_test(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = (),
                       alpha: float = 0.05) -> DataFrame:
    """Pooled-variance test between the two groups ``a`` and ``b`` of column ``group``."""
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else repr(v)

    two = df.where(f"{q(group)} in ({lit(a)}, {lit(b)})")
    m = group_moments(two, value, [*by, group])

    def pick(c: str, v) -> str:
        return f"max(case when {q(group)} = {lit(v)} then {c} end)"

    wide = m.groupBy(*by).agg(*[
        F.expr(pick(c, v)).alias(f"{c}_{s}") for s, v in (("a", a), ("b", b)) for c in ("n", "mean", "var")])
    pooled = "((n_a * var_a + n_b * var_b) / cast(n_a + n_b - 2 as double))"
    t = wide.where("n_a + n_b > 2").withColumns({
        "mean_diff": F.expr("mean_a - mean_b"), "df": F.expr("n_a + n_b - 2"),
        "se": F.expr(f"sqrt({pooled} * (1.0D / n_a + 1.0D / n_b))")})
    t = t.withColumn("t_statistic", F.expr(guarded_ratio("mean_diff", "se")))
    p = t.withColumn("p_value", F.expr(t_p_value("t_statistic", "df")))
    return p.selectExpr(*[q(k) for k in by], "t_statistic", "p_value",
                        f"{significant('p_value', f'{alpha!r}D')} as significant", "mean_diff", "df")


def anova_test(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One-way F over the groups: f_statistic, p_value, significant, n_groups.

    Rows are read once into per-group moments; only those are joined with the grand mean.
    """
    m = group_moments(df, value, [*by, group]).where("n > 0")
    if not by:
        m, keys = m.withColumn("__all", F.lit(1)), ["__all"]
    else:
        keys = list(by)
    grand = m.groupBy(*keys).agg(F.expr(ratio("sum(n * mean)", "sum(n)")).alias("gm"))
    sums = m.join(grand, keys).groupBy(*keys).agg(
        F.expr("sum(n * (mean - gm) * (mean - gm))").alias("ssb"), F.expr("sum(n * var)").alias("ssw"),
        F.expr("cast(sum(n) as bigint)").alias("n"), F.expr("count(1)").alias("n_groups"))
    f = sums.withColumns({"d1": F.expr("n_groups - 1"), "d2": F.expr("n - n_groups")}).where(
        "d1 > 0 and d2 > 0").withColumns({"msb": F.expr("ssb / d1"), "msw": F.expr("ssw / d2")})
    f = f.withColumn("f_statistic", F.expr(guarded_ratio("msb", "msw")))
    p = f.withColumn("p_value", F.expr(f_p_value("f_statistic", "d1", "d2")))
    return p.selectExpr(*[q(b) for b in by], "f_statistic", "p_value",
                        f"{significant('p_value', f'{alpha!r}D')} as significant", "n_groups")


def bonferroni(tests: DataFrame, p: str = "p_value", by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Add n_tests, corrected_alpha, corrected_p (p*m, not clipped), bonferroni_significant.

    The family size comes from a grouped count joined back, so a large family is
    never gathered in one task; the tests are worked out once for both.
    """
    tests = cut_lineage(tests)
    if not by:
        m = tests.count()
        if m == 0:
            raise ZeroDivisionError("no tests to correct")
        sized = tests.withColumn("n_tests", F.lit(m).cast("bigint"))
    else:
        sizes = tests.groupBy(*by).agg(F.expr("count(1)").alias("n_tests"))
        sized = tests.join(sizes, list(by))
    return sized.withColumns({
        "corrected_alpha": F.expr(f"{alpha!r}D / n_tests"),
        "corrected_p": F.expr(f"{q(p)} * n_tests"),
    }).withColumn("bonferroni_significant", F.expr(significant(q(p), "corrected_alpha")))


def config_pairs(runs: DataFrame, by: Sequence[str], config: str = "configuration", run: str = "run",
                 value: str = "value", order: str | None = None) -> DataFrame:
    """Each unordered pair of configurations of one run: (by..., run, config_a, config_b, a, b).

    ``runs`` holds one score per (by, configuration, run): aggregate rows to that level
    first. The equi keys spread the join by run; ``order`` gives the direction of a pair.
    """
    o = order or config
    keys = [*by, run]
    left = runs.selectExpr(*[q(k) for k in keys], f"{q(config)} as config_a", f"{q(o)} as __oa",
                           f"{real(q(value))} as a")
    right = runs.selectExpr(*[q(k) for k in keys], f"{q(config)} as config_b", f"{q(o)} as __ob",
                            f"{real(q(value))} as b")
    return left.join(right, keys).where("__oa < __ob").drop("__oa", "__ob")


def pairwise_comparison(runs: DataFrame, by: Sequence[str], config: str = "configuration", run: str = "run",
                        value: str = "value", order: str | None = None, alpha: float = 0.05,
                        correction: str = "bonferroni") -> DataFrame:
    """All configuration pairs: means, paired t, z, p, Cohen's d, significance, Bonferroni."""
    pairs = config_pairs(runs, by, config, run, value, order)
    key = [*by, "config_a", "config_b"]
    m = pairs.groupBy(*key).agg(
        F.expr("avg(a)").alias("mean_a"), F.expr("avg(b)").alias("mean_b"),
        F.expr("stddev_samp(a)").alias("std_a"), F.expr("stddev_samp(b)").alias("std_b"),
        F.expr("count(a - b)").alias("n"), F.expr("avg(a - b)").alias("md"),
        F.expr("stddev_samp(a - b)").alias("sd"))
    t = m.withColumn("t_statistic", F.expr(guarded_ratio("md", "(sd / sqrt(n))")))
    p = t.withColumn("p_value", F.expr(t_p_value("t_statistic", "(n - 1)")))
    out = p.selectExpr(
        *[q(k) for k in key], "mean_a", "mean_b", "mean_a - mean_b as mean_diff", "t_statistic",
        f"{t_to_z('t_statistic', 'p_value')} as z_statistic", "p_value",
        f"{pooled_d('mean_a', 'std_a', 'n', 'mean_b', 'std_b', 'n')} as cohen_d",
        f"{significant('p_value', f'{alpha!r}D')} as significant")
    if correction == "none":
        return out
    if correction != "bonferroni":
        raise ValueError("correction must be bonferroni or none")
    # Written, since it is read for the counts and for the rows; counts combine map-side, so no experiment is one task.
    out = cut_lineage(out)
    if by:
        sized = out.join(small_side(out.groupBy(*by).agg(F.expr("count(1)").alias("__tests"))), list(by))
    else:
        sized = out.withColumn("__tests", F.lit(out.count()).cast("bigint"))
    return sized.withColumn("corrected_alpha", F.expr(f"{alpha!r}D / __tests")).drop("__tests").withColumn(
        "bonferroni_significant", F.expr(significant("p_value", "corrected_alpha")))


def pairwise_matrix(pairs: DataFrame, metric: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Symmetric configuration x configuration table of one statistic.

    The diagonal is 1 for p values and 0 otherwise; a missing cell stays NULL only for p.
    """
    diag = "1.0D" if metric == "p_value" else "0.0D"
    cells = pairs.selectExpr(
        *[q(b) for b in by],
        f"inline(array(named_struct('r', config_a, 'c', config_b, 'v', {q(metric)}),"
        f" named_struct('r', config_b, 'c', config_a, 'v', {q(metric)}),"
        f" named_struct('r', config_a, 'c', config_a, 'v', {diag}),"
        f" named_struct('r', config_b, 'c', config_b, 'v', {diag})))")
    wide = cells.groupBy(*by, F.col("r").alias("configuration")).pivot("c", list(names)).agg(F.expr("max(v)"))
    return wide if metric == "p_value" else wide.na.fill(0.0, list(names))

"""Building blocks of the check SQL (DuckDB dialect), written independently of the operators.

Tails use finite sums for whole degrees of freedom, quantiles a bisection, so they share
no formula with the continued fractions on the Spark side.
"""

from __future__ import annotations

from ..functions import tails

# l_returnflag || l_linestatus -> configuration name and its order.
CONFIGS = {
    "AF": ("full", 0), "AO": ("baseline", 1), "NF": ("no_scaling", 2), "NO": ("no_feature_engineering", 3),
    "RF": ("no_tuning", 4), "RO": ("minimal", 5),
}
CONFIG_NAMES = [n for n, _ in CONFIGS.values()]

_KEY = "concat(l_returnflag, l_linestatus)"
CONFIG_CASE = "case " + " ".join(f"when {_KEY} = '{k}' then '{n}'" for k, (n, _) in CONFIGS.items()) + " end"
ORDER_CASE = "case " + " ".join(f"when {_KEY} = '{k}' then {o}" for k, (_, o) in CONFIGS.items()) + " end"

RUNS = f"""runs AS (
  SELECT CAST(l_suppkey % 10 AS INTEGER) AS experiment, {CONFIG_CASE} AS configuration,
         {ORDER_CASE} AS cfg_ord, CAST(l_linenumber AS INTEGER) AS run,
         avg(l_discount) AS value, avg(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2, 3, 4)"""

MOMENTS = """moments AS (
  SELECT experiment, configuration, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
         max(value) AS max, count(*) AS n_runs FROM runs GROUP BY 1, 2)"""


def t_p(t: str, nu: str) -> str:
    """Two-sided p of t for whole degrees of freedom (finite trigonometric sums)."""
    th = f"atan(abs({t}) / sqrt({nu}))"
    even = (f"sin({th}) * list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), lambda kk: "
            f"exp(lgamma(kk + 0.5e0) - lgamma(kk + 1.0e0)) / sqrt(pi()) * power(cos({th}), 2 * kk)))")
    odd = (f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, CAST(({nu} - 1) // 2 AS BIGINT)), "
           f"lambda kk: exp(lgamma(kk + 1.0e0) - lgamma(kk + 1.5e0)) * sqrt(pi()) / 2 * power(cos({th}), 2 * kk + 1))), 0))")
    return f"(1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


def t_quantiles(nus: str, alpha: float = 0.05) -> str:
    """CTEs giving tq(nu, q): two-sided critical values by bisection; ``nus`` selects nu."""
    return f"""bis AS (
  SELECT nu, 0.0e0 AS lo, 1000.0e0 AS hi, 0 AS i FROM (SELECT DISTINCT CAST(nu AS BIGINT) AS nu FROM ({nus}) u WHERE nu > 0) v
  UNION ALL
  SELECT nu, CASE WHEN {t_p('((lo + hi) / 2)', 'nu')} > {alpha} THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN {t_p('((lo + hi) / 2)', 'nu')} > {alpha} THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM bis WHERE i < 60),
tq AS (SELECT nu, (lo + hi) / 2 AS q FROM bis WHERE i = 60)"""


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper F tail when d1 or d2 is even (finite sums)."""
    x = f"(({d2}) / (({d2}) + ({d1}) * {f}))"
    a, b = f"(({d2}) / 2.0e0)", f"(({d1}) / 2.0e0)"
    one = (f"power({x}, {a}) * list_sum(list_transform(range(0, CAST(({d1}) // 2 AS BIGINT)), lambda jj: "
           f"exp(lgamma({a} + jj) - lgamma({a}) - lgamma(jj + 1.0e0)) * power(1 - {x}, jj)))")
    two = (f"1 - power(1 - {x}, {b}) * list_sum(list_transform(range(0, CAST(({d2}) // 2 AS BIGINT)), lambda jj: "
           f"exp(lgamma({b} + jj) - lgamma({b}) - lgamma(jj + 1.0e0)) * power({x}, jj)))")
    return f"(CASE WHEN ({d1}) % 2 = 0 THEN {one} WHEN ({d2}) % 2 = 0 THEN {two} END)"


def _poly(coef, x: str) -> str:
    out = f"{coef[-1]!r}"
    for c in reversed(coef[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def norm_upper(tail: str) -> str:
    """z with upper tail ``tail`` <= .5, by the published rational approximation."""
    qq, r = f"(0.5e0 - {tail})", f"sqrt(-ln({tail}))"
    mid = f"(0.180625e0 - {qq} * {qq})"
    centre = f"{qq} * {_poly(tails.AS241_A, mid)} / {_poly(tails.AS241_B, mid)}"
    near = f"{_poly(tails.AS241_C, f'({r} - 1.6e0)')} / {_poly(tails.AS241_D, f'({r} - 1.6e0)')}"
    far = f"{_poly(tails.AS241_E, f'({r} - 5e0)')} / {_poly(tails.AS241_F, f'({r} - 5e0)')}"
    return f"(CASE WHEN {tail} >= 0.075 THEN {centre} WHEN {r} <= 5 THEN {near} ELSE {far} END)"


def pooled_d(ma: str, sa: str, na: str, mb: str, sb: str, nb: str) -> str:
    p = f"sqrt((({na} - 1) * {sa} * {sa} + ({nb} - 1) * {sb} * {sb}) / ({na} + {nb} - 2))"
    return f"CASE WHEN {p} = 0 THEN 0 ELSE ({ma} - {mb}) / {p} END"


def label(d: str, names=("negligible", "small", "medium", "large")) -> str:
    a, b, c, e = names
    return (f"CASE WHEN abs({d}) < 0.2 THEN '{a}' WHEN abs({d}) < 0.5 THEN '{b}'"
            f" WHEN abs({d}) < 0.8 THEN '{c}' WHEN {d} IS NOT NULL THEN '{e}' END")


TITLE = ("Negligible", "Small", "Medium", "Large")


def stars(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN '—' WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**'"
            f" WHEN {p} < 0.05 THEN '*' ELSE 'ns' END")


# The unique row id of lineitem takes five columns.
LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "__q"]
LINE_KEY = ("md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), '{seed}'))")

SUMMARY = f"""{MOMENTS},
{t_quantiles('SELECT n_runs - 1 AS nu FROM moments')},
summary AS (
  SELECT experiment, configuration, mean, std, min, max,
         CASE WHEN n_runs > 1 AND std > 0 THEN mean - q * std / sqrt(n_runs) END AS ci_lower,
         CASE WHEN n_runs > 1 AND std > 0 THEN mean + q * std / sqrt(n_runs) END AS ci_upper, n_runs
  FROM moments LEFT JOIN tq ON nu = n_runs - 1)"""

PAIRS = f"""joined AS (
  SELECT a.experiment, a.configuration AS config_a, b.configuration AS config_b, a.value AS va, b.value AS vb
  FROM runs a JOIN runs b ON a.experiment = b.experiment AND a.run = b.run AND a.cfg_ord < b.cfg_ord),
sums AS (
  SELECT experiment, config_a, config_b, avg(va) AS mean_a, avg(vb) AS mean_b, stddev_samp(va) AS sa,
         stddev_samp(vb) AS sb, count(*) AS n, avg(va - vb) / nullif(stddev_samp(va - vb) / sqrt(count(*)), 0) AS t
  FROM joined GROUP BY 1, 2, 3),
pv AS (SELECT *, {t_p('t', '(n - 1)')} AS p_value FROM sums),
pairs AS (
  SELECT experiment, config_a, config_b, mean_a, mean_b, mean_a - mean_b AS mean_diff, t AS t_statistic,
         sign(t) * {norm_upper('least(greatest(p_value / 2, 1e-12), 0.5)')} AS z_statistic, p_value,
         {pooled_d('mean_a', 'sa', 'n', 'mean_b', 'sb', 'n')} AS cohen_d,
         coalesce(p_value < 0.05, false) AS significant,
         0.05e0 / count(*) OVER (PARTITION BY experiment) AS corrected_alpha,
         coalesce(p_value < 0.05e0 / count(*) OVER (PARTITION BY experiment), false) AS bonferroni_significant
  FROM pv)"""

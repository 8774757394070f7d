"""Statistical tests and report tables over the runs table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparing, hypothesis, ordering, summaries
from ..plans.reporting import statistical_report
from . import sqltext as S
from .inputs import runs
from .registry import query

E = ["experiment"]

query("confidence_interval", "experiment configuration mean:f ci_lower:f ci_upper:f", f"""
WITH RECURSIVE {S.RUNS}, {S.SUMMARY} SELECT * FROM summary""")(
    lambda t: summaries.confidence_interval(runs(t), "value", ["experiment", "configuration"]))

query("summarize_statistics", "experiment configuration mean:f std:f min:f max:f ci_lower:f ci_upper:f n_runs:i", f"""
WITH RECURSIVE {S.RUNS}, {S.SUMMARY} SELECT * FROM summary""")(
    lambda t: summaries.summarize_statistics(runs(t), "value", ["experiment", "configuration"]))

PAIR_SPEC = ("experiment config_a config_b mean_a:f mean_b:f mean_diff:f t_statistic:f z_statistic:f4 p_value:f"
             " cohen_d:f significant bonferroni_significant corrected_alpha:f")


def _pairs(t):
    return hypothesis.pairwise_comparison(runs(t), E, order="cfg_ord")


query("pairwise_comparison", PAIR_SPEC, f"WITH {S.RUNS}, {S.PAIRS} SELECT * FROM pairs")(_pairs)

query("paired_t_test", "experiment t_statistic:f p_value:f significant mean_diff:f n:i", f"""
WITH {S.RUNS}, j AS (
  SELECT a.experiment, a.value AS a, b.value AS b FROM runs a JOIN runs b ON a.experiment = b.experiment
  AND a.run = b.run WHERE a.configuration = 'full' AND b.configuration = 'minimal'),
m AS (SELECT experiment, count(*) AS n, avg(a) - avg(b) AS mean_diff,
        avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t_statistic FROM j GROUP BY 1),
p AS (SELECT *, {S.t_p('t_statistic', '(n - 1)')} AS p_value FROM m)
SELECT *, p_value < 0.05 AS significant FROM p""")(
    lambda t: hypothesis.paired_t_test(
        hypothesis.pair_runs(runs(t).where("configuration = 'full'"), runs(t).where("configuration = 'minimal'"),
                             ["experiment", "run"]), E))

query("independent_t_test", "event_day:i t_statistic:f p_value:f significant mean_diff:f df:i", f"""
WITH g AS (SELECT day(ts) AS event_day, count(*) FILTER (WHERE event_type = 'click') AS na,
  count(*) FILTER (WHERE event_type = 'view') AS nb, avg(value) FILTER (WHERE event_type = 'click') AS ma,
  avg(value) FILTER (WHERE event_type = 'view') AS mb, var_samp(value) FILTER (WHERE event_type = 'click') AS va,
  var_samp(value) FILTER (WHERE event_type = 'view') AS vb FROM events GROUP BY 1),
t AS (SELECT event_day, ma - mb AS mean_diff, na + nb - 2 AS df,
  (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0e0 / na + 1.0e0 / nb)) AS t_statistic FROM g),
p AS (SELECT *, {S.t_p('t_statistic', 'df')} AS p_value FROM t)
SELECT *, p_value < 0.05 AS significant FROM p WHERE t_statistic IS NOT NULL""")(
    lambda t: hypothesis.independent_t_test(
        t.events.selectExpr("day(ts) as event_day", "event_type", "value"), "value", "event_type", "click", "view",
        ["event_day"]))

ANOVA_SQL = f"""
g AS (SELECT experiment, configuration, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM runs GROUP BY 1, 2),
gm AS (SELECT experiment, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1),
s AS (SELECT experiment, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * v) AS ssw, CAST(sum(n) AS BIGINT) AS n,
  count(*) AS n_groups FROM g JOIN gm USING (experiment) GROUP BY 1),
f AS (SELECT *, (ssb / (n_groups - 1)) / nullif(ssw / (n - n_groups), 0) AS f_statistic FROM s)"""

query("anova_test", "experiment f_statistic:f p_value:f significant n_groups:i", f"""
WITH {S.RUNS}, {ANOVA_SQL},
p AS (SELECT *, {S.f_p('f_statistic', 'n_groups - 1', 'n - n_groups')} AS p_value FROM f)
SELECT *, p_value < 0.05 AS significant FROM p""")(
    lambda t: hypothesis.anova_test(runs(t), "value", "configuration", E))

def _report(t):
    report = statistical_report(runs(t), E, "cfg_ord")
    pairs = report["pairwise"].groupBy("experiment").agg(
        F.expr("count(1)").alias("n_pairs"), F.expr("count_if(significant)").alias("n_significant"))
    return report["summary"].join(report["anova"].select("experiment", "f_statistic", "p_value"), "experiment").join(
        pairs, "experiment")


query("statistical_report",
      "experiment configuration mean:f ci_lower:f ci_upper:f f_statistic:f p_value:f n_pairs:i n_significant:i", f"""
WITH RECURSIVE {S.RUNS}, {S.SUMMARY}, {ANOVA_SQL}, {S.PAIRS},
p AS (SELECT experiment, f_statistic, {S.f_p('f_statistic', 'n_groups - 1', 'n - n_groups')} AS p_value FROM f),
c AS (SELECT experiment, count(*) AS n_pairs, count(*) FILTER (WHERE significant) AS n_significant FROM pairs GROUP BY 1)
SELECT * FROM summary JOIN p USING (experiment) JOIN c USING (experiment)""")(_report)

query("anova_rows", "event_day:i f_statistic:f p_value:f significant n_groups:i", f"""
WITH runs AS (SELECT day(ts) AS experiment, event_type AS configuration, value FROM events), {ANOVA_SQL},
p AS (SELECT *, {S.f_p('f_statistic', 'n_groups - 1', 'n - n_groups')} AS p_value FROM f)
SELECT experiment AS event_day, f_statistic, p_value, p_value < 0.05 AS significant, n_groups FROM p""")(
    lambda t: hypothesis.anova_test(
        t.events.selectExpr("day(ts) as event_day", "event_type", "value"), "value", "event_type", ["event_day"]))

query("bonferroni", "experiment config_a config_b n_tests:i corrected_alpha:f corrected_p:f bonferroni_significant", f"""
WITH {S.RUNS}, {S.PAIRS}
SELECT experiment, config_a, config_b, count(*) OVER w AS n_tests, 0.05e0 / count(*) OVER w AS corrected_alpha,
  p_value * count(*) OVER w AS corrected_p, p_value < 0.05e0 / count(*) OVER w AS bonferroni_significant
FROM pairs WINDOW w AS (PARTITION BY experiment)""")(
    lambda t: hypothesis.bonferroni(
        hypothesis.pairwise_comparison(runs(t), E, order="cfg_ord", correction="none"), by=E))


def _two_sided_moments(t):
    s = _summary(t)
    full = s.where("configuration = 'full'").selectExpr("experiment", "mean as mf", "std as sf", "n_runs as nf")
    return s.where("configuration != 'full'").join(full, "experiment")


D_SQL = f"""others AS (
  SELECT m.experiment, m.configuration, m.mean, f.mean AS mf, m.n_runs AS n1, f.n_runs AS n2,
    {S.pooled_d('m.mean', 'm.std', 'm.n_runs', 'f.mean', 'f.std', 'f.n_runs')} AS d
  FROM moments m JOIN moments f ON m.experiment = f.experiment AND f.configuration = 'full'
  WHERE m.configuration != 'full')"""
_D = hypothesis.pooled_d("mean", "std", "n_runs", "mf", "sf", "nf")

query("cohen_d", "experiment configuration d:f", f"WITH {S.RUNS}, {S.MOMENTS}, {D_SQL} SELECT * FROM others")(
    lambda t: _two_sided_moments(t).selectExpr("experiment", "configuration", f"{_D} as d"))


def _d_ci(t):
    return hypothesis.with_d_interval(_two_sided_moments(t).selectExpr("*", f"{_D} as d"), "d", "n_runs", "nf")


query("cohen_d_ci", "experiment configuration d:f d_ci_lower:f d_ci_upper:f", f"""
WITH RECURSIVE {S.RUNS}, {S.MOMENTS}, {D_SQL}, {S.t_quantiles('SELECT n1 + n2 - 2 AS nu FROM others')}
SELECT experiment, configuration, d,
  d - q * sqrt((n1 + n2) / CAST(n1 * n2 AS DOUBLE) + d * d / (2.0e0 * (n1 + n2))) AS d_ci_lower,
  d + q * sqrt((n1 + n2) / CAST(n1 * n2 AS DOUBLE) + d * d / (2.0e0 * (n1 + n2))) AS d_ci_upper
FROM others JOIN tq ON nu = n1 + n2 - 2""")(_d_ci)

query("effect_label", "experiment configuration effect effect_title", f"""
WITH {S.RUNS}, {S.MOMENTS}, {D_SQL} SELECT experiment, configuration, {S.label('d')} AS effect,
  {S.label('d', S.TITLE)} AS effect_title FROM others""")(
    lambda t: _two_sided_moments(t).selectExpr("experiment", "configuration", f"{_D} as d").selectExpr(
        "experiment", "configuration", f"{hypothesis.effect_label('d')} as effect",
        f"{hypothesis.effect_label('d', True)} as effect_title"))

query("p_stars", "experiment config_a config_b stars", f"""
WITH {S.RUNS}, {S.PAIRS} SELECT experiment, config_a, config_b, {S.stars('p_value')} AS stars FROM pairs""")(
    lambda t: _pairs(t).selectExpr("experiment", "config_a", "config_b", f"{hypothesis.p_stars('p_value')} as stars"))

query("t_to_z", "line_no:i z:f4 n:i", f"""
WITH t AS (SELECT l_linenumber AS line_no, CAST(l_quantity AS BIGINT) % 13 - 6 AS k, count(*) AS n FROM lineitem
  GROUP BY 1, 2), p AS (SELECT *, k / 2.0e0 AS tv, {S.t_p('(k / 2.0e0)', '(line_no + 1)')} AS p FROM t)
SELECT line_no, n, sign(tv) * {S.norm_upper('least(greatest(p / 2, 1e-12), 0.5)')} AS z FROM p""")(
    lambda t: t.lineitem.selectExpr("l_linenumber as line_no", "cast(l_quantity as bigint) % 13 - 6 as k")
    .groupBy("line_no", "k").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    .selectExpr("line_no", "n", "k / 2.0D as tv")
    .selectExpr("line_no", "n", "tv", f"{hypothesis.t_p_value('tv', '(line_no + 1)')} as p")
    .selectExpr("line_no", "n", f"{hypothesis.t_to_z('tv', 'p')} as z"))


def _summary(t):
    return summaries.summarize_statistics(runs(t), "value", ["experiment", "configuration"], ordered=False)


query("best_vs_full",
      "experiment best_config best_score:f best_std:f full_score:f full_std:f delta:f t_statistic:f p_value:f"
      " p_interpret cohens_d:f d_ci_lower:f d_ci_upper:f d_interpret n:i bonferroni_significant corrected_alpha:f", f"""
WITH RECURSIVE {S.RUNS}, {S.MOMENTS}, {S.PAIRS},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY mean DESC, configuration) AS rn
  FROM moments WHERE configuration NOT IN ('full', 'baseline')) r WHERE rn = 1),
j AS (SELECT b.experiment, b.configuration AS best_config, b.mean AS best_score, b.std AS best_std, f.mean AS full_score,
  f.std AS full_std, f.n_runs AS n, CASE WHEN config_a = 'full' THEN -t_statistic ELSE t_statistic END AS t_statistic,
  p_value, CASE WHEN config_a = 'full' THEN -cohen_d ELSE cohen_d END AS cohens_d, bonferroni_significant, corrected_alpha
  FROM best b JOIN moments f ON f.experiment = b.experiment AND f.configuration = 'full'
  JOIN pairs p ON p.experiment = b.experiment AND ((config_a = 'full' AND config_b = b.configuration)
    OR (config_b = 'full' AND config_a = b.configuration))),
{S.t_quantiles('SELECT 2 * n - 2 AS nu FROM j')}
SELECT *, best_score - full_score AS delta, {S.stars('p_value')} AS p_interpret, {S.label('cohens_d', S.TITLE)} AS d_interpret,
  cohens_d - q * sqrt(2.0e0 / n + cohens_d * cohens_d / (4.0e0 * n)) AS d_ci_lower,
  cohens_d + q * sqrt(2.0e0 / n + cohens_d * cohens_d / (4.0e0 * n)) AS d_ci_upper
FROM j JOIN tq ON nu = 2 * n - 2""")(
    lambda t: comparing.best_vs_full(_summary(t), _pairs(t), E))

OVER_SQL = f"""{S.RUNS}, {S.SUMMARY},
alt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY mean DESC, configuration) AS rn
  FROM summary WHERE configuration IN ('minimal', 'no_feature_engineering')) r WHERE rn = 1),
eff AS (SELECT a.experiment, a.configuration AS best_config, a.mean AS best_score, a.std AS best_std,
  a.ci_lower AS best_ci_lower, a.ci_upper AS best_ci_upper, f.mean AS full_score, f.std AS full_std,
  a.mean - f.mean AS delta, {S.pooled_d('a.mean', 'a.std', '20', 'f.mean', 'f.std', '20')} AS cohen_d
  FROM alt a JOIN summary f ON f.experiment = a.experiment AND f.configuration = 'full')"""

query("over_engineering_table",
      "experiment best_config best_score:f best_std:f best_ci_lower:f best_ci_upper:f full_score:f full_std:f delta:f"
      " cohen_d:f effect_size", f"""
WITH RECURSIVE {OVER_SQL} SELECT *, {S.label('cohen_d', S.TITLE)} AS effect_size FROM eff""")(
    lambda t: comparing.over_engineering_table(_summary(t), E))

query("forest_table", "experiment best_config delta:f half_width:f cohen_d:f effect_size", f"""
WITH RECURSIVE {OVER_SQL} SELECT *, (best_ci_upper - best_ci_lower) / 2 AS half_width,
{S.label('cohen_d', S.TITLE)} AS effect_size FROM eff""")(
    lambda t: comparing.forest_table(comparing.over_engineering_table(_summary(t), E, ordered=False), E))

query("effect_distribution", "n:i mean_d:f median_d:f mean_delta:f", f"""
WITH RECURSIVE {OVER_SQL} SELECT count(cohen_d) AS n, avg(cohen_d) AS mean_d, median(cohen_d) AS median_d,
avg(delta) AS mean_delta FROM eff""")(
    lambda t: summaries.effect_distribution(comparing.over_engineering_table(_summary(t), E, ordered=False), "cohen_d"))

query("global_report",
      "experiment dataset task_type best_config best_score:f best_std:f baseline_score:f full_score:f"
      " gain_over_baseline:f gain_over_full:f", f"""
WITH {S.RUNS}, {S.MOMENTS},
man AS (SELECT DISTINCT CAST(s_suppkey % 10 AS INTEGER) AS experiment,
  concat('set_', CAST(s_suppkey % 10 AS VARCHAR)) AS dataset,
  CASE WHEN s_suppkey % 10 < 5 THEN 'classification' ELSE 'regression' END AS task_type FROM supplier),
b AS (SELECT experiment, configuration, mean, std,
  row_number() OVER (PARTITION BY experiment ORDER BY mean DESC, configuration) AS rn FROM moments),
r AS (SELECT experiment, max(CASE WHEN rn = 1 THEN configuration END) AS best_config,
  max(CASE WHEN rn = 1 THEN mean END) AS best_score, max(CASE WHEN rn = 1 THEN std END) AS best_std,
  max(CASE WHEN configuration = 'baseline' THEN mean END) AS baseline_score,
  max(CASE WHEN configuration = 'full' THEN mean END) AS full_score FROM b GROUP BY 1)
SELECT *, best_score - baseline_score AS gain_over_baseline, best_score - full_score AS gain_over_full
FROM man JOIN r USING (experiment)""")(
    lambda t: comparing.global_report(_summary(t), t.supplier.selectExpr(
        "cast(s_suppkey % 10 as int) as experiment", "concat('set_', s_suppkey % 10) as dataset",
        "case when s_suppkey % 10 < 5 then 'classification' else 'regression' end as task_type").distinct()))

_N = S.CONFIG_NAMES
_CELLS = ", ".join(
    f"max(CASE WHEN c = '{n}' THEN v END) AS \"{n}\"" for n in _N)
query("pairwise_matrix", "experiment configuration " + " ".join(f"{n}:f" for n in _N), f"""
WITH {S.RUNS}, {S.PAIRS}, cells AS (
  SELECT experiment, config_a AS r, config_b AS c, p_value AS v FROM pairs UNION ALL
  SELECT experiment, config_b, config_a, p_value FROM pairs UNION ALL
  SELECT DISTINCT experiment, configuration, configuration, 1.0e0 FROM runs)
SELECT experiment, r AS configuration, {_CELLS} FROM cells GROUP BY 1, 2""")(
    lambda t: hypothesis.pairwise_matrix(_pairs(t), "p_value", _N, E))

_BOX_SQL = """WITH q AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, q1, median, q3,
  min(l_extendedprice) FILTER (WHERE inside) AS whisker_low, max(l_extendedprice) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM (SELECT *, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem JOIN q USING (l_returnflag, l_linestatus)) x GROUP BY 1, 2, 3, 4, 5"""
query("box_stats",
      "l_returnflag l_linestatus q1:f4 median:f4 q3:f4 whisker_low:f4 whisker_high:f4 n_outliers:i", _BOX_SQL)(
    lambda t: summaries.box_stats(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"]))

query("rank_window", "o_orderkey:i o_totalprice:f rank:i", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")(
    lambda t: ordering.ordered_rank(
        t.orders.select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], "rank"))

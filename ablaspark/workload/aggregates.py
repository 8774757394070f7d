"""Result-table aggregates, comparisons and relational shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, comparing, configs, hypothesis, metrics, profiling, relational, splitting, summaries
from . import sqltext as S
from .inputs import runs
from .registry import query

E = ["experiment"]

# --- runs tables -------------------------------------------------------------------------------

CV_WIDE = """cv AS (
  SELECT event_type AS config_name, CAST(day(ts) AS INTEGER) AS repeat, avg(value) AS mean_accuracy,
    stddev_pop(value) AS mean_f1, avg(value) / 1000.0e0 AS time_sec,
    CASE WHEN day(ts) % 7 = 3 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1, 2, day(ts))"""


def cv_wide(t):
    return t.events.selectExpr("event_type as config_name", "day(ts) as repeat", "value").groupBy(
        "config_name", "repeat").agg(
        F.expr("avg(value)").alias("mean_accuracy"), F.expr("stddev_pop(value)").alias("mean_f1"),
        F.expr("avg(value) / 1000.0D").alias("time_sec")).selectExpr(
        "*", "case when repeat % 7 = 3 then 'failed' else 'success' end as status")


_SUM = ", ".join(
    f"{fn}({m}) AS {b}_{p}" for m, b in (("mean_accuracy", "accuracy"), ("mean_f1", "f1"))
    for p, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
query("summarize_results",
      "config_name accuracy_mean:f accuracy_std:f accuracy_min:f accuracy_max:f f1_mean:f f1_std:f f1_min:f f1_max:f"
      " time_mean:f time_std:f n_experiments:i", f"""
WITH {CV_WIDE} SELECT config_name, {_SUM}, avg(time_sec) AS time_mean, stddev_samp(time_sec) AS time_std,
  count(*) AS n_experiments FROM cv WHERE status = 'success' GROUP BY 1""")(
    lambda t: summaries.summarize_results(cv_wide(t)))

query("compare_to_baseline", "configuration mean:f std:f count:i baseline_value:f delta:f delta_pct:f", f"""
WITH {CV_WIDE}, m AS (SELECT config_name AS configuration, avg(mean_accuracy) AS mean, stddev_samp(mean_accuracy) AS std,
  count(*) AS count FROM cv WHERE status = 'success' GROUP BY 1),
b AS (SELECT mean AS baseline_value FROM m WHERE configuration = 'click')
SELECT *, mean - baseline_value AS delta, (mean - baseline_value) / baseline_value * 100 AS delta_pct FROM m, b""")(
    lambda t: comparing.compare_to_baseline(cv_wide(t), "mean_accuracy", "click"))

query("compare_to_baseline_grouped",
      "experiment configuration mean:f std:f count:i baseline_value:f delta:f delta_pct:f", f"""
WITH {S.RUNS}, {S.MOMENTS}
SELECT m.experiment, m.configuration, m.mean, m.std, m.n_runs AS count, b.mean AS baseline_value, m.mean - b.mean AS delta,
  (m.mean - b.mean) / b.mean * 100 AS delta_pct
FROM moments m JOIN moments b ON m.experiment = b.experiment AND b.configuration = 'full'""")(
    lambda t: comparing.compare_to_baseline(runs(t), "value", "full", E, "configuration"))

query("impact_table", "experiment configuration mean:f improvement:f improvement_pct:f", f"""
WITH {S.RUNS}, {S.MOMENTS}
SELECT m.experiment, m.configuration, m.mean, m.mean - b.mean AS improvement, (m.mean - b.mean) / b.mean * 100 AS improvement_pct
FROM moments m JOIN moments b ON m.experiment = b.experiment AND b.configuration = 'baseline'
WHERE m.configuration != 'baseline'""")(
    lambda t: comparing.impact_table(
        runs(t).groupBy("experiment", "configuration").agg(F.expr("avg(value)").alias("mean")), "mean", by=E))

query("summary_all_datasets", "experiment configuration mean_accuracy:f std_accuracy:f n_runs:i", f"""
WITH {S.RUNS} SELECT experiment, configuration, avg(value) AS mean_accuracy, stddev_pop(value) AS std_accuracy,
  count(*) AS n_runs FROM runs GROUP BY 1, 2""")(
    lambda t: summaries.summary_all_datasets(runs(t), "value", ["experiment", "configuration"]))

_PIV = ", ".join(f"avg(CASE WHEN configuration = '{n}' THEN value END) AS \"{n}\"" for n in S.CONFIG_NAMES)
query("pivot_metric", "experiment " + " ".join(f"{n}:f" for n in S.CONFIG_NAMES), f"""
WITH {S.RUNS} SELECT experiment, {_PIV} FROM runs GROUP BY 1""")(
    lambda t: summaries.pivot_metric(runs(t), "experiment", "configuration", "value", S.CONFIG_NAMES))

# --- comparison records: one per order priority (model) and month (dataset) ----------------------

RECORDS = """rec AS (
  SELECT o_orderpriority AS model, concat('m', CAST(month(o_orderdate) AS VARCHAR)) AS dataset,
    CAST(year(o_orderdate) AS INTEGER) AS ord, avg(o_totalprice) / 1000000.0e0 AS accuracy_mean,
    stddev_pop(o_totalprice) / 1000000.0e0 AS accuracy_std, count(*) / 10.0e0 AS generation_time,
    CASE WHEN year(o_orderdate) % 3 = 0 THEN NULL WHEN year(o_orderdate) % 3 = 1 THEN FALSE ELSE TRUE END AS success,
    CASE WHEN year(o_orderdate) % 2 = 0 THEN '' ELSE concat('m_', CAST(year(o_orderdate) AS VARCHAR)) END AS model_used,
    CASE WHEN o_orderpriority < '3' THEN 'complex' ELSE 'simple' END AS complexity
  FROM orders GROUP BY 1, 2, 3, 7, 8, 9)"""


def records(t):
    return t.orders.selectExpr(
        "o_orderpriority as model", "concat('m', month(o_orderdate)) as dataset", "year(o_orderdate) as ord",
        "o_totalprice").groupBy("model", "dataset", "ord").agg(
        F.expr("avg(o_totalprice) / 1000000.0D").alias("accuracy_mean"),
        F.expr("stddev_pop(o_totalprice) / 1000000.0D").alias("accuracy_std"),
        F.expr("count(1) / 10.0D").alias("generation_time")).selectExpr(
        "*", "case when ord % 3 = 0 then null when ord % 3 = 1 then false else true end as success",
        "case when ord % 2 = 0 then '' else concat('m_', ord) end as model_used",
        "case when model < '3' then 'complex' else 'simple' end as complexity")


_OK = "coalesce(success, TRUE)"
query("filter_success", "model dataset ord:i accuracy_mean:f", f"""
WITH {RECORDS} SELECT * FROM rec WHERE {_OK}""")(lambda t: cleaning.keep_successes(records(t), success="success"))

query("model_averages", "model accuracy_mean:f accuracy_std:f n:i time_mean:f time_min:f time_max:f", f"""
WITH {RECORDS} SELECT model, avg(accuracy_mean) AS accuracy_mean, stddev_samp(accuracy_mean) AS accuracy_std, count(*) AS n,
  avg(generation_time) AS time_mean, min(generation_time) AS time_min, max(generation_time) AS time_max
FROM rec WHERE {_OK} GROUP BY 1""")(
    lambda t: summaries.model_averages(cleaning.keep_successes(records(t), success="success")))

query("reduce_comparison", "dataset model accuracy_mean:f accuracy_std:f generation_time:f model_used pipeline_steps", f"""
WITH {RECORDS} SELECT dataset, model, avg(accuracy_mean) AS accuracy_mean, avg(accuracy_std) AS accuracy_std,
  avg(generation_time) AS generation_time, arg_min(model_used, ord) FILTER (WHERE model_used != '') AS model_used,
  coalesce(arg_min(concat('scaler|', model_used), ord) FILTER (WHERE model_used != ''), '') AS pipeline_steps
FROM rec WHERE {_OK} GROUP BY 1, 2""")(
    lambda t: summaries.reduce_comparison(
        records(t).selectExpr("*", "if(model_used != '', array('scaler', model_used), array()) as pipeline_steps"),
        ["accuracy_mean", "accuracy_std", "generation_time"], "ord"))

query("method_summary", "dataset model accuracy_mean:f4 accuracy_std:f4 complex:f4 model_used", f"""
WITH {RECORDS} SELECT dataset, model, avg(accuracy_mean) AS accuracy_mean, avg(accuracy_std) AS accuracy_std,
  avg(CASE WHEN complexity = 'complex' THEN 1.0e0 ELSE 0.0e0 END) AS complex, arg_min(model_used, ord) AS model_used
FROM rec WHERE {_OK} GROUP BY 1, 2""")(
    lambda t: summaries.method_summary(
        records(t).selectExpr("*", "if(coalesce(success, true), 'success', 'failed') as status",
                              "complexity = 'complex' as complex"),
        ["dataset", "model"], ["accuracy_mean", "accuracy_std"], ["complex"], "model_used", "ord"))

query("complexity_split",
      "complex_n:i simple_n:i complex_pct:f simple_pct:f complex_accuracy:f simple_accuracy:f difference:f", f"""
WITH {RECORDS}, s AS (SELECT count(*) FILTER (WHERE complexity = 'complex') AS complex_n,
  count(*) FILTER (WHERE complexity = 'simple') AS simple_n, count(*) AS n,
  avg(accuracy_mean) FILTER (WHERE complexity = 'complex') AS complex_accuracy,
  avg(accuracy_mean) FILTER (WHERE complexity = 'simple') AS simple_accuracy FROM rec WHERE {_OK})
SELECT *, 100.0e0 * complex_n / n AS complex_pct, 100.0e0 * simple_n / n AS simple_pct,
  complex_accuracy - simple_accuracy AS difference FROM s""")(
    lambda t: summaries.complexity_split(cleaning.keep_successes(records(t), success="success")))

query("best_per_group", "dataset model ord:i accuracy_mean:f model_used", f"""
WITH {RECORDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy_mean DESC, model, ord) AS rn
  FROM rec WHERE {_OK}) r WHERE rn = 1""")(
    lambda t: comparing.best_per_group(
        cleaning.keep_successes(records(t), success="success"), ["dataset"], "accuracy_mean", ["model", "ord"]))

query("best_fastest_overall",
      "best best_accuracy:f fastest fastest_time:f best_documented best_comments:f", f"""
WITH {RECORDS}, m AS (SELECT model, avg(accuracy_mean) AS a, avg(generation_time) AS g, avg(accuracy_std) AS c FROM rec GROUP BY 1)
SELECT (SELECT model FROM m ORDER BY a DESC, model LIMIT 1) AS best, (SELECT max(a) FROM m) AS best_accuracy,
  (SELECT model FROM m ORDER BY g, model LIMIT 1) AS fastest, (SELECT min(g) FROM m) AS fastest_time,
  (SELECT model FROM m ORDER BY c DESC, model LIMIT 1) AS best_documented, (SELECT max(c) FROM m) AS best_comments""")(
    lambda t: comparing.best_fastest_overall(
        records(t).groupBy("model").agg(F.expr("avg(accuracy_mean)").alias("a"), F.expr("avg(generation_time)").alias("g"),
                                        F.expr("avg(accuracy_std)").alias("c")), "model", "a", "g", "c"))

query("adopt_recommendation", "accuracy_range:f advice model", f"""
WITH {RECORDS}, m AS (SELECT model, avg(accuracy_mean) AS a, avg(generation_time) AS g FROM rec GROUP BY 1),
r AS (SELECT max(a) - min(a) AS accuracy_range FROM m)
SELECT accuracy_range, CASE WHEN accuracy_range < 0.01 THEN 'fastest' WHEN accuracy_range > 0.02 THEN 'best' ELSE 'balanced' END AS advice,
  CASE WHEN accuracy_range < 0.01 THEN (SELECT model FROM m ORDER BY g, model LIMIT 1)
       WHEN accuracy_range > 0.02 THEN (SELECT model FROM m ORDER BY a DESC, model LIMIT 1) END AS model FROM r""")(
    lambda t: comparing.adopt_recommendation(
        records(t).groupBy("model").agg(F.expr("avg(accuracy_mean)").alias("accuracy_mean"),
                                        F.expr("avg(generation_time)").alias("generation_time"))))

query("value_counts", "value n:i", """SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1""")(
    lambda t: profiling.value_counts(t.part, "p_type"))

query("rank_metrics", "experiment configuration mean:f rank:i best_vs_worst:f best_vs_worst_pct:f", f"""
WITH {S.RUNS}, m AS (SELECT experiment, configuration, CASE WHEN configuration = 'no_tuning' THEN NULL ELSE avg(value) END AS mean
  FROM runs GROUP BY 1, 2)
SELECT experiment, configuration, mean,
  row_number() OVER (PARTITION BY experiment ORDER BY coalesce(mean, 0) DESC, configuration) AS rank,
  max(coalesce(mean, 0)) OVER w - min(coalesce(mean, 0)) OVER w AS best_vs_worst,
  CASE WHEN min(coalesce(mean, 0)) OVER w = 0 THEN 0 ELSE (max(coalesce(mean, 0)) OVER w - min(coalesce(mean, 0)) OVER w)
    / min(coalesce(mean, 0)) OVER w * 100 END AS best_vs_worst_pct
FROM m WINDOW w AS (PARTITION BY experiment)""")(
    lambda t: metrics.rank_metrics(
        runs(t).groupBy("experiment", "configuration").agg(F.expr("avg(value)").alias("mean")).withColumn(
            "mean", F.expr("case when configuration != 'no_tuning' then mean end")), "mean", E))

# --- folds ---------------------------------------------------------------------------------------

FOLDS = """folds AS (
  SELECT event_type AS config, CAST(user_id % 3 AS INTEGER) AS run, CAST(day(ts) % 5 AS INTEGER) AS fold, avg(value) AS accuracy,
    -avg(value * value) AS neg_mean_squared_error FROM events GROUP BY 1, 2, 3)"""


def folds(t):
    return t.events.selectExpr(
        "event_type as config", "cast(user_id % 3 as int) as run", "cast(day(ts) % 5 as int) as fold", "value",
    ).groupBy("config", "run", "fold").agg(
        F.expr("avg(value)").alias("accuracy"), F.expr("-avg(value * value)").alias("neg_mean_squared_error"))


query("cv_aggregate",
      "config run:i n_folds:i mean_accuracy:f std_accuracy:f min_accuracy:f max_accuracy:f mean_mean_squared_error:f4"
      " std_mean_squared_error:f4 min_mean_squared_error:f4 max_mean_squared_error:f4", f"""
WITH {FOLDS} SELECT config, run, count(*) AS n_folds, avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy,
  min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy, avg(-neg_mean_squared_error) AS mean_mean_squared_error,
  stddev_pop(neg_mean_squared_error) AS std_mean_squared_error, min(-neg_mean_squared_error) AS min_mean_squared_error,
  max(-neg_mean_squared_error) AS max_mean_squared_error FROM folds GROUP BY 1, 2""")(
    lambda t: metrics.cv_aggregate(folds(t), ["accuracy", "neg_mean_squared_error"], ["config", "run"]))

query("repeat_cv", "config score_mean:f score_std:f n_runs:i", f"""
WITH {FOLDS}, f AS (SELECT config, run, fold, CASE WHEN run = 1 AND fold = 2 AND config = 'click' THEN NULL ELSE accuracy END AS s FROM folds),
r AS (SELECT config, run, CASE WHEN count(s) = count(*) THEN avg(s) END AS s FROM f GROUP BY 1, 2)
SELECT config, coalesce(avg(s), 0) AS score_mean, coalesce(stddev_pop(s), 0) AS score_std, count(s) AS n_runs FROM r GROUP BY 1""")(
    lambda t: metrics.repeat_cv(
        folds(t).withColumn("s", F.expr("case when not (run = 1 and fold = 2 and config = 'click') then accuracy end")),
        "s", ["config"]))

# --- tasks and artifacts: part types and brands -----------------------------------------------------

_KIND = ("case p_size % 7 when 0 then 'initialization' when 1 then 'train' when 2 then 'refinement' when 3 then 'ensemble'"
         " when 4 then 'pipeline' else 'other' end")
query("metric_by_task_type", "task artifact_type mean_metric:f count:i", f"""
SELECT p_type AS task, {_KIND} AS artifact_type, avg(p_retailprice) AS mean_metric, count(*) AS count FROM part GROUP BY 1, 2""")(
    lambda t: summaries.metric_by_task_type(
        t.part.selectExpr("p_type as task", f"{_KIND} as artifact_type", "p_retailprice as metric_value")))

query("stage_status", "task has_initialization has_refinement has_ensemble status", f"""
WITH f AS (SELECT concat(p_brand, p_type) AS task, bool_or({_KIND} = 'initialization') AS has_initialization,
  bool_or({_KIND} = 'refinement') AS has_refinement, bool_or({_KIND} = 'ensemble') AS has_ensemble FROM part GROUP BY 1)
SELECT *, CASE WHEN has_initialization AND has_refinement AND has_ensemble THEN 'Complete'
  WHEN has_initialization AND has_refinement THEN 'Partial (no ensemble)' WHEN has_initialization THEN 'Initialization only'
  ELSE 'No artifacts' END AS status FROM f""")(
    lambda t: summaries.stage_status(t.part.selectExpr("concat(p_brand, p_type) as task", f"{_KIND} as artifact_type")))

query("join_metadata", "p_partkey:i task task_type", """
WITH meta AS (SELECT p_type, CASE WHEN avg(p_size) > 25 THEN 'regression' ELSE 'classification' END AS task_type FROM part
  WHERE p_type != 'ECONOMY' GROUP BY 1)
SELECT p_partkey, p.p_type AS task, coalesce(m.task_type, 'unknown') AS task_type FROM part p LEFT JOIN meta m ON p.p_type = m.p_type""")(
    lambda t: relational.join_metadata(
        t.part.selectExpr("p_partkey", "p_type as task"),
        t.part.where("p_type != 'ECONOMY'").groupBy("p_type").agg(F.expr(
            "case when avg(p_size) > 25 then 'regression' else 'classification' end").alias("task_type"))
        .withColumnRenamed("p_type", "task"), "task", "task_type"))

query("join_manifest_defaults", "s_suppkey:i n_runs:i seed:i", """
SELECT s_suppkey, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS INTEGER) END, 20) AS n_runs,
  coalesce(CASE WHEN s_nationkey % 3 = 0 THEN 7 END, 42) AS seed FROM supplier WHERE s_acctbal > 0 AND s_nationkey != 4""")(
    lambda t: relational.apply_defaults(
        t.supplier.selectExpr("s_suppkey", "case when s_nationkey % 2 = 0 then s_nationkey end as n_runs",
                              "case when s_nationkey % 3 = 0 then 7 end as seed",
                              "case when s_nationkey != 4 then s_acctbal > 0 end as enabled"),
        {"n_runs": 20, "seed": 42}))

query("join_runs_equi", "experiment run:i a:f b:f", f"""
WITH {S.RUNS} SELECT a.experiment, a.run, a.value AS a, b.value AS b FROM runs a JOIN runs b
  ON a.experiment = b.experiment AND a.run = b.run WHERE a.configuration = 'full' AND b.configuration = 'baseline'""")(
    lambda t: hypothesis.pair_runs(runs(t).where("configuration = 'full'"), runs(t).where("configuration = 'baseline'"),
                                   ["experiment", "run"]))

query("join_theta_pairs", "experiment run:i config_a config_b a:f b:f", f"""
WITH {S.RUNS} SELECT a.experiment, a.run, a.configuration AS config_a, b.configuration AS config_b, a.value AS a, b.value AS b
FROM runs a JOIN runs b ON a.experiment = b.experiment AND a.run = b.run AND a.cfg_ord < b.cfg_ord""")(
    lambda t: hypothesis.config_pairs(runs(t), E, order="cfg_ord"))

query("dedup_keep_last", "user_id:i event_type event_id:i value:f", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) e
WHERE rn = 1""")(
    lambda t: comparing.dedup_keep_last(
        t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]))

query("union_frames", "source name balance:f nation:i", """
SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance, CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL
SELECT 'supplier', s_name, NULL, s_nationkey FROM supplier""")(
    lambda t: relational.union_frames({
        "customer": t.customer.selectExpr("c_name as name", "c_acctbal as balance"),
        "supplier": t.supplier.selectExpr("s_name as name", "s_nationkey as nation")}))

query("set_diff_columns", "nationkey:i side n:i", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
d AS (SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b ON a.k = b.k)
SELECT nationkey, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d) AS n FROM d WHERE d != 0""")(
    lambda t: relational.set_difference(t.customer.selectExpr("c_nationkey as nationkey"),
                                        t.supplier.selectExpr("s_nationkey as nationkey")))

_LATEST = ("concat('results/', o_orderpriority, '/summary_statistics_', CASE WHEN o_custkey % 5 = 0 THEN '' ELSE "
           "concat({date}, '_', {pad}) END, '.csv')")
query("latest_artifact", "experiment path stamp usable", f"""
WITH f AS (SELECT concat(o_orderpriority, '/', CAST(o_custkey % 50 AS VARCHAR)) AS experiment,
  {_LATEST.format(date="strftime(o_orderdate, '%Y%m%d')", pad="lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0')")} AS path,
  CASE WHEN o_orderstatus = 'F' THEN 20 WHEN o_orderstatus = 'O' THEN 5 END AS full_n_runs FROM orders),
s AS (SELECT *, coalesce(full_n_runs = 20, FALSE) AS ok,
  coalesce(nullif(regexp_extract(path, '_([0-9]{{8}}_[0-9]{{6}})[.]csv$', 1), ''), '00000000_000000') AS stamp FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY ok DESC, stamp DESC, path DESC) AS rn FROM s)
SELECT experiment, path, stamp, ok AS usable FROM r WHERE rn = 1""")(
    lambda t: comparing.latest_artifact(t.orders.selectExpr(
        "concat(o_orderpriority, '/', o_custkey % 50) as experiment",
        _LATEST.format(date="date_format(o_orderdate, 'yyyyMMdd')", pad="lpad(cast(o_orderkey % 240000 as string), 6, '0')")
        + " as path", "case when o_orderstatus = 'F' then 20 when o_orderstatus = 'O' then 5 end as full_n_runs",
        "20 as expected_n_runs")))

# --- configurations ----------------------------------------------------------------------------------

_CFG = """SELECT p_partkey, p_name AS name, p_size % 2 = 0 AS use_scaling, p_size % 3 = 0 AS use_feature_engineering,
  p_size % 5 = 0 AS use_hyperparam_tuning, p_size % 7 = 0 AS use_ensembling,
  CASE WHEN p_size % 11 = 0 THEN p_name END AS description,
  CASE p_partkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'minmax' ELSE 'robust' END AS scaler_type FROM part"""
query("config_table", "p_partkey:i name scaler_type description active_components:i is_full", f"""
WITH c AS ({_CFG}), n AS (SELECT *, CAST(use_scaling AS INTEGER) + CAST(use_feature_engineering AS INTEGER)
  + CAST(use_hyperparam_tuning AS INTEGER) + CAST(use_ensembling AS INTEGER) AS active_components FROM c)
SELECT p_partkey, name, CASE WHEN use_scaling THEN scaler_type ELSE 'none' END AS scaler_type,
  coalesce(description, CASE WHEN active_components = 0 THEN 'Мінімальний pipeline (тільки базова модель)' ELSE
    concat('Pipeline з: ', concat_ws(', ', CASE WHEN use_scaling THEN concat('масштабування (', scaler_type, ')') END,
      CASE WHEN use_feature_engineering THEN 'інженерія ознак' END,
      CASE WHEN use_hyperparam_tuning THEN 'тюнінг гіперпараметрів' END,
      CASE WHEN use_ensembling THEN 'ансамблювання' END)) END) AS description,
  active_components, active_components = 4 AS is_full FROM n""")(
    lambda t: configs.normalize_configs(t.part.selectExpr(
        "p_partkey", "p_name as name", "p_size % 2 = 0 as use_scaling", "p_size % 3 = 0 as use_feature_engineering",
        "p_size % 5 = 0 as use_hyperparam_tuning", "p_size % 7 = 0 as use_ensembling",
        "case when p_size % 11 = 0 then p_name end as description",
        "case p_partkey % 3 when 0 then 'standard' when 1 then 'minmax' else 'robust' end as scaler_type")))

_STAGES = [c.name for c in configs.cumulative_configs()]
query("config_cumulative", "o_orderpriority configuration active_components:i n:i", f"""
WITH s AS (SELECT unnest({_STAGES!r}) AS configuration, unnest([0, 1, 2, 3, 4]) AS active_components)
SELECT o_orderpriority, configuration, active_components, count(*) AS n FROM orders, s
WHERE o_orderkey % 5 <= active_components GROUP BY 1, 2, 3""")(
    lambda t: configs.cross_grid(
        t.orders.groupBy("o_orderpriority", F.expr("o_orderkey % 5 as k")).agg(F.expr("count(1)").alias("c")),
        active_components=[0, 1, 2, 3, 4])
    .where("k <= active_components").groupBy("o_orderpriority", "active_components").agg(F.expr("sum(c)").alias("n"))
    .selectExpr("o_orderpriority", "active_components", "n",
                f"array({', '.join(repr(s) for s in _STAGES)})[active_components] as configuration"))

query("cross_grid", "c_custkey:i config seed:i model", """
SELECT c_custkey, config, seed, model FROM customer, (SELECT unnest(['full', 'minimal']) AS config) a,
  (SELECT unnest([42, 43, 44]) AS seed) b, (SELECT unnest(['rf', 'gbt']) AS model) c""")(
    lambda t: configs.cross_grid(t.customer.select("c_custkey"), config=["full", "minimal"], seed=[42, 43, 44],
                                 model=["rf", "gbt"]))

query("seed_schedule", "s_suppkey:i run:i random_state:i", """
SELECT s_suppkey, i + 1 AS run, 42 + i AS random_state FROM supplier, (SELECT unnest(range(0, 20)) AS i) r""")(
    lambda t: splitting.seed_schedule(t.supplier.select("s_suppkey"), 20))

# --- report tables -------------------------------------------------------------------------------------

TABLE2 = f"""{S.RUNS}, {S.SUMMARY}, t2 AS (
  SELECT concat('set_', CAST(experiment AS VARCHAR)) AS dataset, CASE WHEN experiment % 2 = 0 THEN 'a' ELSE '' END AS variant,
    configuration, mean, std, n_runs, ci_lower, ci_upper FROM summary)"""


def table2(t):
    return summaries.summarize_statistics(runs(t), "value", ["experiment", "configuration"]).selectExpr(
        "concat('set_', experiment) as dataset", "if(experiment % 2 = 0, 'a', '') as variant", "configuration", "mean",
        "std", "n_runs", "ci_lower", "ci_upper")


query("select_table2",
      "dataset variant configuration accuracy_mean:f4 accuracy_std:f4 n_runs:i ci_lower:f4 ci_upper:f4", f"""
WITH RECURSIVE {TABLE2} SELECT dataset, variant, configuration, mean AS accuracy_mean, std AS accuracy_std, n_runs, ci_lower, ci_upper FROM t2""")(
    lambda t: cleaning.results_table(table2(t), 4))

query("filter_n_runs", "event_type user_id:i mean:f n_runs:i", """
SELECT event_type, user_id, avg(value) AS mean, count(*) AS n_runs FROM events GROUP BY 1, 2 HAVING count(*) = 20""")(
    lambda t: cleaning.keep_n_runs(t.events.groupBy("event_type", "user_id").agg(
        F.expr("avg(value)").alias("mean"), F.expr("count(1)").alias("n_runs"))))

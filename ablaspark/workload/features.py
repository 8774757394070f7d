"""Profiling, cleaning, splitting, scaling, selection, metrics and votes on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, features, metrics, profiling, splitting, voting
from . import sqltext as S
from .inputs import lines
from .registry import query

# --- profiling and cleaning ---------------------------------------------------------------------
# The tables hold no gaps, so NULL, NaN and infinities are cut in by a modulus of the key.

GAPPY = """gappy AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_score,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"""


def gappy(t):
    return t.events.selectExpr(
        "event_id", "case when event_id % 7 = 0 then null when event_id % 11 = 0 then double('NaN') else value end as value",
        "case when event_id % 13 != 0 then cast(user_id as double) end as user_score",
        "case when event_id % 17 != 0 then event_type end as event_type")


query("profile_table", "n_rows:i n_columns:i missing_cells:i", f"""
WITH {GAPPY} SELECT count(*) AS n_rows, 4 AS n_columns, count(*) FILTER (WHERE value IS NULL OR isnan(value))
  + count(*) FILTER (WHERE user_score IS NULL) + count(*) FILTER (WHERE event_type IS NULL) AS missing_cells FROM gappy""")(
    lambda t: profiling.profile_table(gappy(t)))

query("profile_target", "value n:i", f"""
WITH {GAPPY} SELECT event_type AS value, count(*) AS n FROM gappy WHERE event_type IS NOT NULL GROUP BY 1""")(
    lambda t: profiling.value_counts(gappy(t), "event_type"))

query("drop_missing_rows", "event_id:i value:f user_score:f event_type", f"""
WITH {GAPPY} SELECT * FROM gappy WHERE value IS NOT NULL AND NOT isnan(value) AND user_score IS NOT NULL AND event_type IS NOT NULL""")(
    lambda t: cleaning.drop_missing_rows(gappy(t), ["value", "user_score"], "event_type"))

query("cap_infinite", "event_id:i value", f"""
WITH {GAPPY}, i AS (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'inf'::DOUBLE WHEN event_id % 5 = 2 THEN '-inf'::DOUBLE ELSE value END AS v FROM gappy)
SELECT event_id, CASE WHEN v = 'inf'::DOUBLE THEN 1.7976931348623157e308 WHEN v = '-inf'::DOUBLE THEN -1.7976931348623157e308
  WHEN v IS NULL OR isnan(v) THEN 0e0 ELSE v END AS value FROM i""")(
    lambda t: cleaning.cap_infinite(gappy(t).selectExpr(
        "event_id", "case when event_id % 5 = 1 then double('Infinity') when event_id % 5 = 2 then double('-Infinity')"
        " else value end as value"), ["value"]))

query("infer_task_type", "target task_type", """
SELECT 'l_quantity' AS target, 'regression' AS task_type UNION ALL
SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem UNION ALL
SELECT 'l_suppkey', CASE WHEN count(DISTINCT l_suppkey) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem UNION ALL
SELECT 'l_orderkey', 'classification' FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 1""")(
    lambda t: profiling.infer_task_type(t.lineitem, "l_quantity")
    .unionByName(profiling.infer_task_type(t.lineitem, "l_linenumber"))
    .unionByName(profiling.infer_task_type(t.lineitem, "l_suppkey"))
    .unionByName(profiling.infer_task_type(t.lineitem, "l_orderkey", forced="classification")))

query("fill_median", "event_id:i value:f user_score:f", f"""
WITH {GAPPY}, m AS (SELECT median(CASE WHEN NOT isnan(value) THEN value END) AS mv, median(user_score) AS mu FROM gappy)
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN mv ELSE value END AS value, coalesce(user_score, mu) AS user_score FROM gappy, m""")(
    lambda t: cleaning.fill_median(gappy(t), ["value", "user_score"]))

query("label_encode", "event_id:i event_type:i", f"""
WITH {GAPPY}, d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(event_type, 'nan') AS v FROM gappy) x)
SELECT event_id, code AS event_type FROM gappy JOIN d ON coalesce(event_type, 'nan') = v""")(
    lambda t: cleaning.label_encode(gappy(t), "event_type"))

query("label_encode_wide", "c_custkey:i code:i", """
WITH d AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer) x)
SELECT c_custkey, code FROM customer JOIN d USING (c_name)""")(
    lambda t: cleaning.label_encode(t.customer, "c_name", "code"))

query("interaction_terms", "l_orderkey:i l_linenumber:i price_x_discount:f4 quantity_x_tax:f", """
SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS price_x_discount, l_quantity * l_tax AS quantity_x_tax FROM lineitem""")(
    lambda t: cleaning.interaction_terms(t.lineitem, {
        "price_x_discount": ("l_extendedprice", "l_discount"), "quantity_x_tax": ("l_quantity", "l_tax"),
        "skipped": ("l_quantity", "absent")}))

query("drop_columns", "c_nationkey:i c_acctbal:f c_mktsegment", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")(
    lambda t: cleaning.drop_columns(t.customer, ["c_custkey", "c_name"]))



def _leak_train(t):
    return t.lineitem.selectExpr(
        "ascii(l_returnflag) as label", "l_quantity", "l_extendedprice", "l_discount", "2.0D * ascii(l_returnflag) as copied",
        "1.0D as constant", "l_suppkey", "l_shipdate as timestamp")


query("leakage_check", "check column value:f", """
WITH b AS (SELECT ascii(l_returnflag) AS y, l_quantity, l_extendedprice, l_discount, 2.0e0 * ascii(l_returnflag) AS copied, l_suppkey FROM lineitem),
r AS (SELECT unnest([{'c': 'l_quantity', 'r': corr(y, l_quantity)}, {'c': 'l_extendedprice', 'r': corr(y, l_extendedprice)},
  {'c': 'l_discount', 'r': corr(y, l_discount)}, {'c': 'copied', 'r': corr(y, copied)}, {'c': 'l_suppkey', 'r': corr(y, l_suppkey)}], recursive := true) FROM b)
SELECT 'target_correlation' AS check, c AS column, abs(r) AS value FROM r WHERE abs(r) > 0.95 UNION ALL
SELECT 'time_column', 'timestamp', NULL UNION ALL SELECT 'column_mismatch', 'l_suppkey', NULL""")(
    lambda t: profiling.leakage_check(_leak_train(t), _leak_train(t).drop("l_suppkey"), "label"))

# --- splits and folds ----------------------------------------------------------------------------------

_IDS = S.LINE_IDS
_LKEY = S.LINE_KEY.format(seed=42)
_LCOLS = "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_quantity:f"

query("split_holdout", f"{_LCOLS} split", f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY {_LKEY}) AS rn, count(*) OVER () AS n FROM lineitem)
SELECT *, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM k""")(
    lambda t: splitting.split_holdout(lines(t), _IDS))

_STRAT = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS rn FROM {table}),
c AS (SELECT {label} AS cl, count(*) AS n FROM {table} GROUP BY 1),
q AS (SELECT cl, n, CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS nt, CAST(sum(n) OVER () AS BIGINT) AS total FROM c),
b AS (SELECT cl, nt, n * nt // total AS base, n * nt % total AS rest FROM q),
s AS (SELECT cl, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(cl AS VARCHAR)) <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b)
SELECT *, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM k JOIN s ON {label} = cl"""
query("split_stratified", f"{_LCOLS} l_returnflag split",
      _STRAT.format(label="l_returnflag", key=_LKEY, table="lineitem"))(
    lambda t: splitting.split_stratified(lines(t), _IDS, "l_returnflag"))

query("kfold", "o_orderkey:i fold:i", """
WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, '42'))) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS fold FROM k""")(
    lambda t: splitting.kfold(t.orders, ["o_orderkey"], 7))

query("stratified_kfold", "o_orderkey:i o_orderstatus fold:i", """
WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', o_orderkey, '42'))) AS rn FROM orders),
pos AS (SELECT o_orderstatus, (row_number() OVER (ORDER BY o_orderstatus) - 1) % 5 AS f FROM orders),
sizes AS (SELECT o_orderstatus, f, count(*) AS c FROM pos GROUP BY 1, 2),
ends AS (SELECT o_orderstatus, f, sum(c) OVER (PARTITION BY o_orderstatus ORDER BY f) AS hi, sum(c) OVER (PARTITION BY o_orderstatus ORDER BY f) - c AS lo FROM sizes)
SELECT o_orderkey, k.o_orderstatus, f AS fold FROM k JOIN ends e ON k.o_orderstatus = e.o_orderstatus AND rn > lo AND rn <= hi""")(
    lambda t: splitting.stratified_kfold(t.orders, ["o_orderkey"], "o_orderstatus"))

query("dataset_info",
      "label n:i class_pct:f n_samples:i n_features:i n_classes:i train_size:i test_size:i", f"""
WITH s AS ({_STRAT.format(label="o_orderstatus", key="md5(concat_ws('|', o_orderkey, '42'))", table="orders")}),
z AS (SELECT count(*) AS n_samples, count(*) FILTER (WHERE split = 'train') AS train_size, count(*) FILTER (WHERE split = 'test') AS test_size FROM s)
SELECT o_orderstatus AS label, count(*) AS n, 100.0e0 * count(*) / any_value(train_size) AS class_pct, any_value(n_samples) AS n_samples, 2 AS n_features,
  (SELECT count(DISTINCT o_orderstatus) FROM s WHERE split = 'train') AS n_classes, any_value(train_size) AS train_size, any_value(test_size) AS test_size
FROM s, z WHERE split = 'train' GROUP BY 1""")(
    lambda t: profiling.dataset_info(splitting.split_stratified(t.orders, ["o_orderkey"], "o_orderstatus"),
                                     "o_orderstatus", ["o_totalprice", "o_custkey"]))

# --- imputing, scaling, selecting -------------------------------------------------------------------------

query("impute_mean", "event_id:i value:f user_score:f", f"""
WITH {GAPPY}, m AS (SELECT avg(CASE WHEN NOT isnan(value) THEN value END) AS mv, avg(user_score) AS mu FROM gappy)
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN mv ELSE value END AS value, coalesce(user_score, mu) AS user_score FROM gappy, m""")(
    lambda t: features.fit_imputer(gappy(t), ["value", "user_score"], "mean").transform(gappy(t)))

query("impute_median", "event_id:i value:f", f"""
WITH {GAPPY}, m AS (SELECT median(CASE WHEN NOT isnan(value) THEN value END) AS mv FROM gappy WHERE event_id % 2 = 0)
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN mv ELSE value END AS value FROM gappy, m""")(
    lambda t: features.fit_imputer(gappy(t).where("event_id % 2 = 0"), ["value"], "median").transform(gappy(t)))

query("impute_most_frequent", "event_id:i event_type user_score:f", f"""
WITH {GAPPY}, a AS (SELECT event_type AS m1 FROM gappy WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1),
b AS (SELECT user_score AS m2 FROM gappy WHERE user_score IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_score LIMIT 1)
SELECT event_id, coalesce(event_type, m1) AS event_type, coalesce(user_score, m2) AS user_score FROM gappy, a, b""")(
    lambda t: features.fit_imputer(gappy(t), ["event_type", "user_score"], "most_frequent").transform(gappy(t)))

_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


def _scaled(sql_mid: str, sql_span: str) -> str:
    stats = ", ".join(f"{sql_mid.format(c=c)} AS m_{c}, {sql_span.format(c=c)} AS s_{c}" for c in _COLS)
    outs = ", ".join(f"(l.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in _COLS)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {outs} FROM lineitem l, s"


_SCALE_SPEC = "l_orderkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_tax:f"
query("scale_standard", _SCALE_SPEC, _scaled("avg({c})", "stddev_pop({c})"))(
    lambda t: features.fit_scaler(t.lineitem, _COLS, "standard").transform(t.lineitem))
query("scale_minmax", _SCALE_SPEC, _scaled("min({c})", "max({c}) - min({c})"))(
    lambda t: features.fit_scaler(t.lineitem, _COLS, "minmax").transform(t.lineitem))
query("scale_robust", _SCALE_SPEC, _scaled("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))(
    lambda t: features.fit_scaler(t.lineitem, _COLS, "robust").transform(t.lineitem))

_FCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


def _f_sql(c: str, i: int) -> str:
    return f"""SELECT {i} AS pos, '{c}' AS column, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag) x"""


query("select_k_best", "column f_score:f", " UNION ALL ".join(_f_sql(c, i) for i, c in enumerate(_FCOLS)).join(
    ["SELECT * FROM (", ") u ORDER BY f_score DESC, pos DESC LIMIT 4"]))(
    lambda t: features.select_k_best(t.lineitem, "l_returnflag", _FCOLS, 4))

# --- dummies, votes -------------------------------------------------------------------------------------------

query("dummy_classifier", "o_orderkey:i prediction", """
WITH m AS (SELECT o_orderstatus AS prediction FROM orders WHERE o_orderkey % 5 != 0 GROUP BY 1 ORDER BY count(*) DESC, o_orderstatus LIMIT 1)
SELECT o_orderkey, prediction FROM orders, m WHERE o_orderkey % 5 = 0""")(
    lambda t: features.predict_constant(
        t.orders.where("o_orderkey % 5 = 0"),
        features.dummy_class(t.orders.where("o_orderkey % 5 != 0"), "o_orderstatus")))

query("dummy_regressor", "o_orderkey:i prediction:f4", """
WITH m AS (SELECT avg(o_totalprice) AS prediction FROM orders WHERE o_orderkey % 5 != 0)
SELECT o_orderkey, prediction FROM orders, m WHERE o_orderkey % 5 = 0""")(
    lambda t: features.predict_constant(
        t.orders.where("o_orderkey % 5 = 0"),
        t.orders.where("o_orderkey % 5 != 0").agg(F.expr("avg(o_totalprice)").alias("prediction"))))

# Members: three rules on lineitem; scores with many ties.
MEMBERS = """members AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p1, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS p2,
  CASE WHEN l_tax > 0.03 THEN 2 ELSE 0 END AS p3, l_quantity / 50.0e0 AS s1, l_discount * 10 AS s2, floor(l_extendedprice / 5000) AS s3 FROM lineitem)"""


def members(t):
    return lines(t).selectExpr(
        "*", "if(l_linestatus = 'O', 1, 0) as label", "if(l_quantity > 25, 1, 0) as p1", "if(l_discount > 0.05D, 1, 0) as p2",
        "if(l_tax > 0.03D, 2, 0) as p3", "l_quantity / 50.0D as s1", "l_discount * 10 as s2",
        "floor(l_extendedprice / 5000) as s3")


query("vote_hard", f"{_LCOLS} vote:i", f"""
WITH {MEMBERS} SELECT *, (SELECT v FROM (SELECT unnest([p1, p2, p3]) AS v) u GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS vote FROM members""")(
    lambda t: voting.vote_hard(members(t), ["p1", "p2", "p3"]))

_W = voting.member_weights([0.8, 0.15, 0.5])
query("vote_soft_weighted", f"{_LCOLS} p_one:f vote:i", f"""
WITH {MEMBERS}, p AS (SELECT *, (0.64e0 * s1 + 0.25e0 * least(l_tax * 9, 1)) / 0.89e0 AS p_one,
  (0.64e0 * (1 - s1) + 0.25e0 * (1 - least(l_tax * 9, 1))) / 0.89e0 AS p_zero FROM members)
SELECT *, CASE WHEN p_one > p_zero THEN 1 ELSE 0 END AS vote FROM p""")(
    lambda t: voting.vote_soft(
        members(t).selectExpr("*", "1 - s1 as z1", "1 - s2 as z2", "least(l_tax * 9, 1.0D) as s4",
                              "1 - least(l_tax * 9, 1.0D) as z4"),
        [["z1", "s1"], ["z2", "s2"], ["z4", "s4"]], [0, 1], _W).selectExpr(
        "*", "vote_proba[1] as p_one"))

query("vote_regressor", f"{_LCOLS} vote:f", f"""WITH {MEMBERS} SELECT *, (s1 + s2 + s3) / 3.0e0 AS vote FROM members""")(
    lambda t: voting.vote_regressor(members(t), ["s1", "s2", "s3"]))

query("best_ensemble", "l_returnflag voting_score:f weighted_score:f best_ensemble best_score:f", f"""
WITH {MEMBERS}, s AS (SELECT l_returnflag, avg(CASE WHEN p1 = label THEN 1.0e0 ELSE 0 END) AS voting_score,
  avg(CASE WHEN p2 = label THEN 1.0e0 ELSE 0 END) AS w FROM members GROUP BY 1),
n AS (SELECT l_returnflag, voting_score, CASE WHEN l_returnflag != 'N' THEN w END AS weighted_score FROM s)
SELECT *, CASE WHEN coalesce(weighted_score, 0) > voting_score THEN 'weighted_ensemble' ELSE 'voting_ensemble' END AS best_ensemble,
  greatest(coalesce(weighted_score, 0), voting_score) AS best_score FROM n""")(
    lambda t: voting.best_ensemble(
        members(t).groupBy("l_returnflag").agg(
            F.expr("avg(if(p1 = label, 1.0D, 0.0D))").alias("voting_score"),
            F.expr("avg(if(p2 = label, 1.0D, 0.0D))").alias("weighted_score")).withColumn(
            "weighted_score", F.expr("case when l_returnflag != 'N' then weighted_score end"))))

# --- metrics ----------------------------------------------------------------------------------------------------

CLASSES = """pred AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 35 THEN 'A' WHEN l_discount > 0.06 THEN 'R' WHEN l_tax > 0.07 THEN 'X' ELSE 'N' END AS p FROM lineitem),
u AS (SELECT y AS c FROM pred UNION SELECT p FROM pred),
cls AS (SELECT c AS class, (SELECT count(*) FROM pred WHERE y = c AND p = c) AS tp, (SELECT count(*) FROM pred WHERE y = c) AS support,
  (SELECT count(*) FROM pred WHERE p = c) AS predicted FROM u),
pc AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2.0e0 * tp / nullif(predicted + support, 0), 0) AS f1_score FROM cls)"""


def classes(t):
    return t.lineitem.selectExpr(
        "l_returnflag as y", "case when l_quantity > 35 then 'A' when l_discount > 0.06D then 'R' when l_tax > 0.07D then 'X' else 'N' end as p")


_AVG = "accuracy:f precision:f recall:f f1_score:f"
query("classification_metrics", _AVG, f"""
WITH {CLASSES} SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score FROM pc""")(
    lambda t: metrics.classification_metrics(classes(t), "y", "p"))
query("macro_metrics", _AVG, f"""
WITH {CLASSES} SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1_score) AS f1_score FROM pc""")(
    lambda t: metrics.macro_metrics(classes(t), "y", "p"))

query("binary_metrics", f"l_returnflag {_AVG}", f"""
WITH {MEMBERS}, c AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE label = 1 AND p1 = 1) AS tp, count(*) FILTER (WHERE label = 0 AND p1 = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND p1 = 0) AS fn, count(*) FILTER (WHERE label = p1) AS hit FROM members GROUP BY 1)
SELECT l_returnflag, hit / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score FROM c""")(
    lambda t: metrics.binary_metrics(members(t), "label", "p1", by=["l_returnflag"]))

query("confusion_matrix", "label p_A:i p_N:i p_R:i p_X:i", f"""
WITH {CLASSES} SELECT y AS label, count(*) FILTER (WHERE p = 'A') AS p_A, count(*) FILTER (WHERE p = 'N') AS p_N,
  count(*) FILTER (WHERE p = 'R') AS p_R, count(*) FILTER (WHERE p = 'X') AS p_X FROM pred GROUP BY 1""")(
    lambda t: metrics.confusion_matrix(classes(t), "y", "p", ["A", "N", "R", "X"]))

query("per_class_metrics", "class precision:f recall:f f1_score:f support:i", f"WITH {CLASSES} SELECT * FROM pc")(
    lambda t: metrics.per_class_metrics(metrics.confusion_counts(classes(t), "y", "p")))

query("classification_report", "name precision:f recall:f f1_score:f support:i", f"""
WITH {CLASSES}, a AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
  sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1_score * support) / sum(support) AS wf FROM pc)
SELECT class AS name, precision, recall, f1_score, support FROM pc UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM a UNION ALL
SELECT 'macro avg', mp, mr, mf, n FROM a UNION ALL SELECT 'weighted avg', wp, wr, wf, n FROM a""")(
    lambda t: metrics.classification_report(classes(t), "y", "p"))


def _auc_sql(table: str, y: str, s: str, by: str) -> str:
    return f"""SELECT {by}, (sum(CASE WHEN {y} THEN rk END) - sum(CASE WHEN {y} THEN 1 ELSE 0 END) * (sum(CASE WHEN {y} THEN 1 ELSE 0 END) + 1) / 2.0e0)
    / nullif(sum(CASE WHEN {y} THEN 1.0e0 ELSE 0 END) * sum(CASE WHEN {y} THEN 0e0 ELSE 1 END), 0) AS roc_auc, sum(CASE WHEN {y} THEN 1 ELSE 0 END) AS n_pos
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0e0 AS rk FROM {table}) x GROUP BY 1"""


query("roc_auc", "l_returnflag roc_auc:f", f"WITH {MEMBERS} {_auc_sql('members', 'label = 1', 's3', 'l_returnflag')}")(
    lambda t: metrics.roc_auc(members(t), "label", "s3", by=["l_returnflag"]))

query("roc_auc_continuous", "roc_auc:f", f"""
WITH b AS (SELECT 1 AS g, l_linestatus = 'O' AS y, l_extendedprice AS s FROM lineitem) {_auc_sql('b', 'y', 's', 'g')}""")(
    lambda t: metrics.roc_auc(t.lineitem, "l_linestatus", "l_extendedprice", "'O'"))

query("roc_auc_ovr", "roc_auc:f", f"""
WITH b AS (SELECT l_returnflag AS y, unnest([{{'c': 'A', 's': l_quantity}}, {{'c': 'N', 's': floor(l_extendedprice / 900)}}, {{'c': 'R', 's': l_discount}}], recursive := true) FROM lineitem),
a AS ({_auc_sql('b', 'y = c', 's', 'c')}) SELECT sum(roc_auc * n_pos) / sum(n_pos) AS roc_auc FROM a""")(
    lambda t: metrics.roc_auc_ovr(t.lineitem.selectExpr("l_returnflag", "l_quantity", "floor(l_extendedprice / 900) as b", "l_discount"),
                                  "l_returnflag", {"A": "l_quantity", "N": "b", "R": "l_discount"}))

query("regression_metrics", "l_returnflag mse:f rmse:f mae:f r2_score:f", """
WITH b AS (SELECT l_returnflag, l_extendedprice / 1000.0e0 AS y, l_quantity * 2.0e0 AS p FROM lineitem)
SELECT l_returnflag, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
  1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2_score FROM b GROUP BY 1""")(
    lambda t: metrics.regression_metrics(
        t.lineitem.selectExpr("l_returnflag", "l_extendedprice / 1000.0D as y", "l_quantity * 2.0D as p"), "y", "p",
        ["l_returnflag"]))

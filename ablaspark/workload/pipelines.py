"""Pipelines as trees of rows, and configurations as lines of JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs, steps
from ..operators.configs import TOGGLES, standard_configs
from .registry import query

# --- pipelines: kinds of preprocessors, feature steps and models, dealt over the parts ---------------

#: (kind, node, parent, pos, role, class, name); searches and ensembles hold each other in several ways.
_NODES = [
    ("pre0", 0, None, 0, "step", "StandardScaler", "scaler"),
    ("pre1", 0, None, 0, "step", "Pipeline", "prep"), ("pre1", 1, 0, 0, "inner", "SimpleImputer", "imputer"),
    ("pre1", 2, 0, 1, "inner", "StandardScaler", "Scaler"),
    ("pre2", 0, None, 0, "step", "Pipeline", "preproc"), ("pre2", 1, 0, 0, "inner", "MinMaxScaler", "min_max_scale"),
    ("pre3", 0, None, 0, "step", "SimpleImputer", "imputer"), ("pre3", 1, None, 1, "step", "StandardScaler", "scaler"),
    ("fe0", 3, None, 2, "step", "PCA", "reduce"), ("fe1", 3, None, 2, "step", "Pipeline", "shrink"), ("fe1", 4, 3, 0, "inner", "PCA", "p"),
    ("fe2", 3, None, 2, "step", "SelectKBest", "best_ten"),
    ("m0", 10, None, 9, "step", "LogisticRegression", "clf"),
    ("m1", 10, None, 9, "step", "GridSearchCV", "estimator"), ("m1", 11, 10, 0, "estimator", "RandomForestClassifier", "rf"),
    ("m2", 10, None, 9, "step", "VotingClassifier", "my_model"), ("m2", 11, 10, 1, "member", "LogisticRegression", "lr"),
    ("m2", 12, 10, 0, "member", "RandomizedSearchCV", "tuned"), ("m2", 13, 12, 0, "estimator", "SVC", "svc"),
    ("m3", 10, None, 9, "step", "StackingClassifier", "model"), ("m3", 11, 10, 0, "member", "RandomForestClassifier", "rf"),
    ("m3", 12, 10, 5, "final", "VotingClassifier", "vote"), ("m3", 13, 12, 0, "member", "GridSearchCV", "search"),
    ("m3", 14, 13, 0, "estimator", "LogisticRegression", "lr"), ("m3", 15, 12, 1, "member", "SVC", "svc"),
    ("m4", 10, None, 9, "step", "StackingRegressor", "regressor"), ("m4", 11, 10, 1, "member", "BaggingRegressor", "bags"),
    ("m4", 12, 10, 2, "member", "Ridge", "ridge"), ("m4", 13, 11, 0, "base", "DecisionTreeRegressor", "tree"),
    ("m5", 10, None, 9, "step", "BaggingClassifier", "clf_1"), ("m5", 11, 10, 0, "base", "GridSearchCV", "gs"),
    ("m5", 12, 11, 0, "estimator", "VotingClassifier", "v"), ("m5", 13, 12, 0, "member", "KNeighborsClassifier", "knn"),
    ("m5", 14, 12, 1, "member", "GaussianNB", "nb"),
    ("m6", 10, None, 9, "step", "VotingClassifier", "model"),  # a vote without members stays
]
_ROWS = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in _NODES)
_COLUMNS = "kind, node, parent, pos, role, class, name"
_KIND = "kind = concat('pre', {p} % 4) or kind = concat('fe', {p} % 5) or kind = concat('m', {s} % 7)".format(p="p_partkey", s="p_size")


def nested_pipelines(t):
    kinds = t.spark.sql(f"select * from values {_ROWS} as v({_COLUMNS})")
    wanted = t.part.selectExpr("p_partkey as pipeline", "explode(array(concat('pre', p_partkey % 4), concat('fe', p_partkey % 5),"
                               " concat('m', p_size % 7))) as kind")
    return wanted.join(F.broadcast(kinds), "kind").drop("kind")  # a fixed table of some forty rows


def _list(names):
    return ", ".join(repr(n) for n in names)


_CONFIGS = ", ".join(f"('{c.name}', " + ", ".join(str(getattr(c, x)) for x in TOGGLES) + ")" for c in standard_configs())
_KID = "(SELECT k.{v} FROM n k WHERE k.pipeline = {p}.pipeline AND k.parent = {p}.node AND k.role = '{r}' ORDER BY k.pos LIMIT 1)"

query("ablate_pipeline", "pipeline:i configuration pos:i step class inner:a", f"""
WITH RECURSIVE v({_COLUMNS}) AS (VALUES {_ROWS}), cfg(configuration, {', '.join(TOGGLES)}) AS (VALUES {_CONFIGS}),
n AS (SELECT p_partkey AS pipeline, node, parent, pos, role, class, name FROM part JOIN v ON {_KIND}),
parts AS (SELECT pipeline, parent AS node, list(name ORDER BY pos) AS names, bool_or(class = 'PCA') AS pca FROM n WHERE role = 'inner' GROUP BY ALL),
roots AS (SELECT n.*, coalesce(names, []) AS names, coalesce(pca, false) AS pca FROM n LEFT JOIN parts USING (pipeline, node) WHERE n.parent IS NULL),
canon AS (SELECT *, CASE {' '.join(f"WHEN lower(name) IN ({_list(ns)}) THEN '{c}'" for c, ns in steps.SYNONYMS.items())}
  WHEN class = 'PCA' OR pca THEN 'feature_engineering' {' '.join(
      f"WHEN {' OR '.join([f'contains(lower(name), {p!r})' for p in ps] + ([f'starts_with(lower(name), {b!r})'] if b else []))} THEN '{c}'"
      for c, ps, b in steps.HINTS)} ELSE name END AS c FROM roots),
named AS (SELECT *, CASE WHEN nth = 1 THEN c ELSE concat(c, '_', nth - 1) END AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, c ORDER BY pos) AS nth FROM canon) x),
grid AS (SELECT * FROM named, cfg),
walk AS (
  SELECT pipeline, configuration, use_hyperparam_tuning AS tuning, use_ensembling AS ensembling, node, class, 0 AS depth FROM grid WHERE step = 'model'
  UNION ALL
  SELECT w.pipeline, w.configuration, tuning, ensembling, k.node, k.class, depth + 1 FROM walk w JOIN n k ON k.pipeline = w.pipeline AND k.node =
    CASE WHEN w.class IN ({_list(steps.TUNER_CLASSES)}) AND NOT tuning THEN {_KID.format(v='node', p='w', r='estimator')}
         WHEN w.class IN ({_list(steps.VOTING_CLASSES)}) AND NOT ensembling THEN {_KID.format(v='node', p='w', r='member')}
         WHEN w.class IN ({_list(steps.STACKING_CLASSES)}) AND NOT ensembling
           THEN coalesce({_KID.format(v='node', p='w', r='final')}, {_KID.format(v='node', p='w', r='member')})
         WHEN w.class IN ({_list(steps.BAGGING_CLASSES)}) AND NOT ensembling THEN {_KID.format(v='node', p='w', r='base')} END),
ends AS (SELECT pipeline, configuration, arg_max(class, depth) AS class FROM walk GROUP BY ALL),
lefts AS (SELECT *, CASE WHEN step = 'preprocessor' AND NOT use_scaling THEN list_filter(names, lambda x: NOT contains(lower(x), 'scale')) ELSE names END AS kept FROM grid)
SELECT pipeline, configuration, pos, step, coalesce(e.class, l.class) AS class, CASE WHEN step = 'model' THEN [] ELSE kept END AS inner FROM lefts l
LEFT JOIN (SELECT *, 'model' AS step FROM ends) e USING (pipeline, configuration, step)
WHERE NOT (step = 'preprocessor' AND NOT use_scaling AND len(kept) = 0) AND NOT (step = 'feature_engineering' AND NOT use_feature_engineering)""")(
    lambda t: steps.ablate_pipelines(nested_pipelines(t), standard_configs()))

# --- configurations written by hand --------------------------------------------------------------------

_LINE = """concat(case p_partkey % 9 when 6 then '["no", "object"' when 3 then '{{"name": " "' else concat('{{"name": "', p_name, '"') end,
  case p_partkey % 9 when 1 then ', "use_scaling": false, "scaler_type": "robust"' when 2 then ', "scaler_type": "cubic"'
    when 4 then ', "use_magic": true, "depth": 3' when 5 then ', "use_ensembling": "maybe", "use_scaling": "TRUE"' when 6 then ']'
    when 7 then ', "scaler_type": "Robust", "zeal": 1, "extra": "none"' when 8 then ', "extra": {{"k": "v"}}, "description": "own words", "use_ensembling": false'
    else ', "use_feature_engineering": false, "use_hyperparam_tuning": false, "model_type": "svm"' end, case when p_partkey % 9 = 6 then '' else '}}' end)""".format()


def _custom(t):
    good, rejects = configs.read_configs(t.part.selectExpr("p_partkey", f"{_LINE} as value"))
    columns = "name, use_scaling, use_ensembling, model_type, scaler_type, description, active_components"
    left = ["p_partkey", "reasons", *columns.split(", ")]
    return good.selectExpr("p_partkey", "array('good') as reasons", *columns.split(", ")).unionByName(
        rejects, allowMissingColumns=True).select(*left)


_J = "json_extract_string(line, '$.{}')"
_SW = ", ".join(f"CASE WHEN lower({_J.format(x)}) NOT IN ('true', 'false') THEN '{x} is neither true nor false' END" for x in TOGGLES)
_KNOWN = ["name", *TOGGLES, "model_type", "scaler_type", "description", "extra"]
_ON = " + ".join(f"CAST({x} AS INTEGER)" for x in TOGGLES)
query("config_custom", "p_partkey:i reasons:a name use_scaling use_ensembling model_type scaler_type description active_components:i", f"""
WITH l AS (SELECT p_partkey, {_LINE} AS line FROM part),
j AS (SELECT p_partkey, line, json_type(line) = 'OBJECT' AS ok FROM l),
r AS (SELECT *, list_filter(list_concat([CASE WHEN NOT ok THEN 'not a JSON object' END, CASE WHEN ok AND trim(coalesce({_J.format('name')}, '')) = '' THEN 'no name' END],
  CASE WHEN ok THEN list_transform(list_sort(list_filter(json_keys(line), lambda k: NOT list_contains({_KNOWN!r}, k))), lambda k: concat('unknown field ', k)) ELSE [] END,
  [{_SW}, CASE WHEN {_J.format('scaler_type')} NOT IN ({_list(configs.SCALER_TYPES)}) THEN concat('unknown scaler_type ', {_J.format('scaler_type')}) END,
   CASE WHEN json_type(line, '$.extra') != 'OBJECT' THEN 'extra is not an object' END]), lambda x: x IS NOT NULL) AS reasons FROM j),
g AS (SELECT p_partkey, {_J.format('name')} AS name, {', '.join(f"coalesce(lower({_J.format(x)}) = 'true', true) AS {x}" for x in TOGGLES)},
  coalesce({_J.format('model_type')}, 'default') AS model_type, coalesce({_J.format('scaler_type')}, 'standard') AS scaler_type,
  {_J.format('description')} AS description FROM r WHERE len(reasons) = 0)
SELECT p_partkey, ['good'] AS reasons, name, use_scaling, use_ensembling, model_type, CASE WHEN use_scaling THEN scaler_type ELSE 'none' END AS scaler_type,
  coalesce(description, concat('Pipeline з: ', concat_ws(', ', CASE WHEN use_scaling THEN concat('масштабування (', scaler_type, ')') END,
    CASE WHEN use_feature_engineering THEN 'інженерія ознак' END, CASE WHEN use_hyperparam_tuning THEN 'тюнінг гіперпараметрів' END,
    CASE WHEN use_ensembling THEN 'ансамблювання' END))) AS description, {_ON} AS active_components FROM g
UNION ALL SELECT p_partkey, reasons, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE len(reasons) > 0""")(_custom)

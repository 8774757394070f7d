"""Fitted models, tuning and learned feature stages on whole tables.

Closed forms are checked by SQL; forests, boosting and the like return their scores,
and the tests check their properties.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import learners, metrics, stages
from ..operators.splitting import split_stratified, stratified_kfold
from .registry import query

DOC_FEATURES = ["n_chars", "n_lines", "digits", "uppers", "ats", "words"]


def labelled_docs(t):
    """Labelled documents with simple text features; the text itself is dropped early."""
    docs = t.documents.selectExpr(
        "doc_id", "cast(n_chars as double) as n_chars", "cast(size(split(text, '\\n')) as double) as n_lines",
        "cast(length(text) - length(regexp_replace(text, '[0-9]', '')) as double) as digits",
        "cast(length(text) - length(regexp_replace(text, '[A-Z]', '')) as double) as uppers",
        "cast(length(text) - length(replace(text, '@', '')) as double) as ats",
        "cast(size(split(text, ' ')) as double) as words", "lang", "source")
    return docs.join(t.labels.selectExpr("doc_id", "cast(quality as double) as label"), "doc_id")


def doc_split(t):
    split = split_stratified(labelled_docs(t), ["doc_id"], "label", 0.25, 7).persist()
    parts = stages.assemble(DOC_FEATURES)
    return tuple(parts.transform(split.where(f"split = '{s}'").drop("split")) for s in ("train", "test"))


def vectors(t):
    from pyspark.ml.functions import array_to_vector

    return t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"),
                               array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def vector_split(t):
    split = split_stratified(vectors(t), ["vec_id"], "label", 0.2, 42).persist()
    return tuple(split.where(f"split = '{s}'").drop("split") for s in ("train", "test"))


def _scores(predictions):
    return metrics.classification_metrics(predictions.select("label", "prediction"), "label", "prediction")


_AVG = "accuracy:f precision:f recall:f f1_score:f"


def _coefficients(t, model):
    return t.spark.createDataFrame(
        [(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


query("linear_regression", "slope:f4 intercept:f4", """
SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem""")(
    lambda t: _coefficients(t, learners.linear().fit(
        stages.assemble(["l_quantity"]).transform(t.lineitem.selectExpr("l_quantity", "l_extendedprice as label")))))

query("ridge", "slope:f4 intercept:f4", """
WITH m AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, count(*) AS n, var_pop(p_size) AS vx, covar_pop(p_retailprice, p_size) AS c FROM part)
SELECT n * c / (n * vx + 1000) AS slope, my - mx * n * c / (n * vx + 1000) AS intercept FROM m""")(
    lambda t: _coefficients(t, learners.ridge(1000.0).fit(
        stages.assemble(["p_size"]).transform(t.part.selectExpr("p_size", "p_retailprice as label")))))


def _newton_sql(steps: int = 12) -> str:
    """Newton steps of the penalised likelihood (C = 1, free intercept), one after another."""
    chain = ["d AS MATERIALIZED (SELECT CAST(l_quantity AS DOUBLE) / 10 - 2.5e0 AS x,"
             " CASE WHEN l_extendedprice + 1000 * l_quantity > 75000 THEN 1.0e0 ELSE 0.0e0 END AS y FROM lineitem)",
             "b0 AS MATERIALIZED (SELECT 0.0e0 AS w, 0.0e0 AS b)"]
    for k in range(steps):
        chain += [
            f"p{k} AS (SELECT w, b, x, y, 1 / (1 + exp(-(w * x + b))) AS p FROM d, b{k})",
            f"s{k} AS (SELECT any_value(w) AS w, any_value(b) AS b, sum((p - y) * x) + any_value(w) AS gw, sum(p - y) AS gb,"
            f" sum(p * (1 - p) * x * x) + 1 AS ww, sum(p * (1 - p) * x) AS wb, sum(p * (1 - p)) AS bb FROM p{k})",
            f"b{k + 1} AS MATERIALIZED (SELECT w - (bb * gw - wb * gb) / (ww * bb - wb * wb) AS w,"
            f" b - (ww * gb - wb * gw) / (ww * bb - wb * wb) AS b FROM s{k})"]
    return f"WITH {', '.join(chain)} SELECT w AS slope, b AS intercept FROM b{steps}"


query("logistic_coefficients", "slope:f4 intercept:f4", _newton_sql())(
    lambda t: _coefficients(t, learners.logistic(1.0).fit(stages.assemble(["x"]).transform(t.lineitem.selectExpr(
        "cast(l_quantity as double) / 10 - 2.5D as x", "if(l_extendedprice + 1000 * l_quantity > 75000, 1D, 0D) as label")))))


def _fit_score(estimator, parts):
    train, test = parts
    return _scores(estimator.fit(train).transform(test))


query("logistic_regression", _AVG)(lambda t: _fit_score(learners.logistic(1.0), vector_split(t)))
query("random_forest", _AVG)(lambda t: _fit_score(learners.forest(trees=20, depth=5), vector_split(t)))
query("gradient_boosting", _AVG)(lambda t: _fit_score(learners.boosting(trees=10), doc_split(t)))
query("svc_rbf", _AVG)(lambda t: _fit_score(learners.svc_rbf(10.0, "scale", 128, classes=2), doc_split_scaled(t)))
query("svc_rbf_converged", "components:i doubled:i change:f enough")(lambda t: _changes(t, learners.svc_rbf_converged(
    10.0, "scale", start=64, most=1024, tolerance=0.02).fit(doc_split_scaled(t)[0])))
query("mlp", _AVG)(lambda t: _fit_score(learners.perceptron([16], 64, 10, max_iter=60), vector_split(t)))


def _changes(t, model):
    """How many held-out decisions change when the random features double, and whether that ends the search."""
    rows = [(a, b, float(share), share <= 0.02) for a, b, share in model.detail["changes"]]
    return t.spark.createDataFrame(rows, "components int, doubled int, change double, enough boolean")


def doc_split_scaled(t):
    split = split_stratified(labelled_docs(t), ["doc_id"], "label", 0.25, 7).persist()
    train, test = (split.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
    fitted = stages.fit_scaler(train, DOC_FEATURES, "standard")
    parts = stages.assemble(DOC_FEATURES)
    return parts.transform(fitted.transform(train)), parts.transform(fitted.transform(test))


query("regression_forest", "mse:f4 rmse:f4 mae:f4 r2_score:f4")(
    lambda t: metrics.regression_metrics(
        learners.forest("regression", trees=10, depth=5).fit(_part(t).where("p_partkey % 5 != 0"))
        .transform(_part(t).where("p_partkey % 5 = 0")).select("label", "prediction"), "label", "prediction"))


def _part(t):
    return stages.assemble(["p_size", "brand"]).transform(t.part.selectExpr(
        "p_partkey", "p_size", "cast(substring(p_brand, 7) as double) as brand", "p_retailprice as label"))


def _search_rows(t, search):
    train, test = doc_split(t)
    folded = stratified_kfold(train, ["doc_id"], "label", 3)
    model = search.fit(folded)
    best = {p.name: v for p, v in model.getEstimatorParamMaps()[
        max(range(len(model.avgMetrics)), key=lambda i: model.avgMetrics[i])].items()}
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a),
             {p.name: v for p, v in m.items()} == best)
            for m, a in zip(model.getEstimatorParamMaps(), model.avgMetrics)]
    return t.spark.createDataFrame(rows, "params string, f1 double, chosen boolean")


query("grid_search", "params f1:f chosen")(lambda t: _search_rows(t, learners.grid_search(
    learners.forest(trees=10), {"maxDepth": [2, 5], "minInstancesPerNode": [1, 4]}, "f1", fold="fold")))
query("random_search", "params f1:f chosen")(lambda t: _search_rows(t, learners.random_search(
    learners.forest(trees=10), learners.FOREST_GRID | {"numTrees": [5, 10]}, 3, "f1", fold="fold")))


def _power(t):
    fitted = stages.fit_power(t.lineitem, ["l_extendedprice", "l_quantity"])
    done = fitted.transform(t.lineitem)
    rows = t.spark.createDataFrame(list(fitted.lambdas.items()), "column string, lambda double")
    stats = done.agg(*[F.expr(f"{f}({c})").alias(f"{f}_{c}") for c in fitted.lambdas for f in ("avg", "stddev_pop", "skewness")])
    long = stats.selectExpr("inline(array(" + ", ".join(
        f"named_struct('column', '{c}', 'mean', avg_{c}, 'std', stddev_pop_{c}, 'skew', skewness_{c})" for c in fitted.lambdas) + "))")
    return rows.join(long, "column")


def _power_sql(rounds: int = 13) -> str:
    """The likelihood on nested grids, one column beside the other."""
    y = ("(CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-12 THEN ln(1 + x) ELSE (power(x + 1, lam) - 1) / lam END"
         " ELSE CASE WHEN abs(lam - 2) < 1e-12 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - lam) - 1) / (2 - lam) END END)")
    steps = ["d AS MATERIALIZED (SELECT 'l_extendedprice' AS col, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem"
             " UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem)",
             "s AS MATERIALIZED (SELECT col, count(x) AS n, sum(sign(x) * ln(1 + abs(x))) AS l FROM d GROUP BY col)",
             "b0 AS MATERIALIZED (SELECT col, -4.0e0 AS lo, 6.0e0 AS hi FROM s)"]
    for k in range(rounds):
        steps += [f"g{k} AS MATERIALIZED (SELECT col, lo + j * (hi - lo) / 8 AS lam, (hi - lo) / 8 AS step FROM b{k}, range(9) r(j))",
                  f"b{k + 1} AS MATERIALIZED (SELECT col, arg_max(lam, ll) - any_value(step) AS lo, arg_max(lam, ll) + any_value(step) AS hi FROM"
                  f" (SELECT col, lam, step, -any_value(n) / 2 * ln(var_pop({y})) + (lam - 1) * any_value(l) AS ll FROM g{k} JOIN d USING (col)"
                  " JOIN s USING (col) GROUP BY col, lam, step) GROUP BY col)"]
    return f"""WITH {', '.join(steps)}, f AS (SELECT col, (lo + hi) / 2 AS lam FROM b{rounds}), t AS (SELECT col, lam, {y} AS y FROM d JOIN f USING (col)),
m AS (SELECT col, avg(y) AS m, stddev_pop(y) AS s FROM t GROUP BY col)
SELECT col AS "column", any_value(lam) AS lambda, avg((y - m) / s) AS mean, stddev_pop((y - m) / s) AS std,
  avg(power((y - m) / s, 3)) AS skew FROM t JOIN m USING (col) GROUP BY col"""


query("power_transform", "column lambda:f4 mean:f std:f skew:f4", _power_sql())(_power)

query("one_hot", "c_custkey:i hot:a", """
WITH s AS (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, (SELECT list(CASE WHEN v = c_mktsegment THEN '1' ELSE '0' END ORDER BY v) FROM s) AS hot FROM customer""")(
    lambda t: stages.one_hot(["c_mktsegment"]).fit(t.customer.where("c_custkey % 2 = 0")).transform(t.customer).select(
        "c_custkey", F.transform(vector_to_array("c_mktsegment_hot"), lambda x: x.cast("int").cast("string")).alias("hot")))

query("column_transformer", "c_custkey:i features:a", """
WITH f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer), k AS (SELECT DISTINCT c_mktsegment AS v FROM customer)
SELECT c_custkey, list_prepend(CAST(CAST(round((c_acctbal - m) / s * 1000) AS BIGINT) AS VARCHAR),
  (SELECT list(CASE WHEN v = c_mktsegment THEN '1000' ELSE '0' END ORDER BY v) FROM k)) AS features FROM customer, f""")(
    lambda t: stages.column_transformer([
        ([stages.scale(["c_acctbal"])], ["c_acctbal"]), ([stages.one_hot(["c_mktsegment"])], ["c_mktsegment_hot"])])
    .fit(t.customer).transform(t.customer).select("c_custkey", F.transform(
        vector_to_array("features"), lambda x: F.round(x * 1000).cast("bigint").cast("string")).alias("features")))


def _pca(t):
    model = stages.variance_pca("features", "pca", 0.95).fit(vectors(t))
    ratios = model.detail["ratios"]
    rows = [(i + 1, float(r), i < model.detail["k"]) for i, r in enumerate(ratios)]
    return t.spark.createDataFrame(rows, "component int, ratio double, kept boolean")


query("pca_variance", "component:i ratio:f kept")(_pca)


def _names(t, indices):
    return t.spark.createDataFrame([(i, DOC_FEATURES[i]) for i in indices], "pos int, column string")


query("rfe", "pos:i column")(lambda t: _names(t, learners.recursive_elimination(doc_split(t)[0], 3)))
query("select_from_model", "pos:i column")(
    lambda t: _names(t, learners.select_from_model(doc_split(t)[0], trees=10)))

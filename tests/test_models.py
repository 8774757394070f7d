"""Learners and stages against closed forms and direct computation."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ablaspark.operators import learners, stages
from ablaspark.plans import linear_grid


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 10.0]
    y = x @ [2.0, -1.0, 4.0] + 7.0 + rng.normal(size=200)
    return x, y


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y = numbers
    rows = [(i, *map(float, r), float(v), int(v > np.median(y))) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, cls int").cache()


def test_ridge_closed_form(table, numbers):
    x, y = numbers
    parts = stages.assemble(["a", "b", "c"])
    model = learners.ridge(5.0, label="y").fit(parts.transform(table))
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-5)


def test_logistic_matches_newton(table, numbers):
    x, y = numbers
    t = (y > np.median(y)).astype(float)
    model = learners.logistic(0.1, label="cls").fit(stages.assemble(["a", "b", "c"]).transform(table))
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(4)
    reg = np.diag([0.0, 10.0, 10.0, 10.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + reg, z.T @ (p - t) + reg @ w)
    assert np.allclose(model.coefficients.toArray(), w[1:], atol=1e-3)


def test_power_transform_maximises_likelihood(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=400)) - 0.5
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    fitted = stages.fit_power(df, ["x"])

    def shape(v, lam):
        pos = np.log1p(v) if abs(lam) < 1e-12 else ((v + 1) ** lam - 1) / lam
        neg = -np.log1p(-v) if abs(lam - 2) < 1e-12 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)
        return np.where(v >= 0, pos, neg)

    def likelihood(lam):
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.array([float(shape(np.array(v), lam)) if v >= 0 or True else 0 for v in x])
        return -len(x) / 2 * math.log(t.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    with np.errstate(all="ignore"):
        grid = np.linspace(-3, 3, 1201)
        best = grid[int(np.nanargmax([likelihood(g) for g in grid]))]
    assert fitted.lambdas["x"] == pytest.approx(best, abs=0.01)
    row = fitted.transform(df).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)


def test_power_spread_is_put_together_from_tasks(spark):
    """One pass for all exponents; before, every exponent was an aggregate of its own in code too large to compile."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 3, 5000), np.exp(rng.normal(8, 1, 5000))
    rows = [(float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    base = spark.createDataFrame(rows, "x0 double, x1 double").repartition(5).union(spark.sql("select 'NaN'::double, null::double"))
    grids = {0: np.array([-1.0, 0.0, 0.5, 2.0, 3.0]), 1: np.array([0.0, 0.7, 1e4])}
    got = stages._power_variances(base, grids)
    for i, grid in grids.items():
        v = base.selectExpr(f"nanvl(x{i}, null) as v")
        for j, lam in enumerate(grid[:2] if i else grid):
            want = v.agg(F.expr(f"var_pop({stages._yeo_johnson('v', f'{float(lam)!r}D')})")).first()[0]
            assert got[i, j] == pytest.approx(want, rel=1e-9)
    assert not np.isfinite(got[1, 2]) and stages._power_variances(base.where("false"), grids) == {}


def test_one_hot_unknown_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "s string")
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "s string")
    out = stages.one_hot(["s"]).fit(train).transform(test)
    assert [list(r[0]) for r in out.select(vector_to_array("s_hot")).collect()] == [[1, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_column_transformer_drops_the_rest(table):
    out = stages.column_transformer([([stages.impute(["a"], "median"), stages.scale(["a"])], ["a"]), ([], ["b"])]).fit(
        table).transform(table)
    first = out.orderBy("id").select(vector_to_array("features").alias("f"), "b").first()
    assert len(first["f"]) == 2 and first["f"][1] == first["b"]


def test_pca_keeps_share_and_centres(table, numbers):
    x, _ = numbers
    data = stages.assemble(["a", "b", "c"], "raw").transform(table)
    model = stages.variance_pca("raw", "pca", 0.95).fit(data)
    ratios = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    ratios /= ratios.sum()
    assert np.allclose(model.detail["ratios"], ratios, atol=1e-9)
    assert model.detail["k"] == int(np.searchsorted(np.cumsum(ratios), 0.95)) + 1
    means = model.transform(data).select(vector_to_array("pca").alias("p")).agg(F.avg(F.col("p")[0])).first()[0]
    assert means == pytest.approx(0, abs=1e-9)


def test_random_features_double_until_decisions_stay(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = (np.hypot(*x.T) > 1.1).astype(float)
    rows = [(float(a), float(b), float(k)) for (a, b), k in zip(x, y)]
    data = stages.assemble(["a", "b"]).transform(spark.createDataFrame(rows, "a double, b double, label double").coalesce(2))
    model = learners.svc_rbf_converged(10.0, 1.0, start=16, most=512, tolerance=0.08, max_iter=20).fit(data)
    seen = model.detail["changes"]
    assert [(a, b) for a, b, _ in seen] == [(16 << i, 32 << i) for i in range(len(seen))]
    assert model.detail["converged"] and seen[-1][2] <= 0.08 and all(share > 0.08 for *_, share in seen[:-1])
    assert model.detail["components"] == seen[-1][1]
    out = model.transform(data).select("label", "prediction").toPandas()
    assert (out["label"] == out["prediction"]).mean() > 0.93
    assert not learners.svc_rbf_converged(10.0, 1.0, start=4, most=4, max_iter=2).fit(data).detail["converged"]


def test_fourier_features_approach_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "a array<double>").select(
        array_to_vector("a").alias("features"))
    out = stages.fourier_features(4000, 0.3).fit(df).transform(df)
    z = np.array([r[0] for r in out.select(vector_to_array("rbf")).collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.1
    auto = stages.fourier_features(8, "scale").fit(df).detail["gamma"]
    assert auto == pytest.approx(1 / (4 * x.var()))


def test_svc_separates_a_ring(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a * a + b * b < 1.5)) for a, b in x], "a double, b double, label double")
    data = stages.assemble(["a", "b"]).transform(df)
    out = learners.svc_rbf(10.0, 1.0, 200).fit(data).transform(data)
    assert out.where("prediction = label").count() / 400 > 0.95


def test_boosting_goes_one_vs_rest(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 3) + (i % 7) / 20) for i in range(90)], "label double, x double")
    data = stages.assemble(["x"]).transform(df)
    out = learners.boosting(trees=3, classes=3).fit(data).transform(data)
    assert out.where("prediction = label").count() == 90


def test_elimination_and_selection_find_the_signal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(*map(float, r), float(r[2] > 0)) for r in x], "a double, b double, c double, d double, label double")
    data = stages.assemble(["a", "b", "c", "d"]).transform(df)
    assert learners.recursive_elimination(data, 1, trees=5) == [2]
    assert learners.select_from_model(data, trees=5) == [2]


def test_search_points():
    grid = {"a": [1, 2, 3], "b": [4, 5]}
    assert len(learners.grid_points(grid)) == 6
    some = learners.sample_points(grid, 4, seed=1)
    assert len({tuple(p.items()) for p in some}) == 4 and some == learners.sample_points(grid, 4, seed=1)
    assert len(learners.sample_points(grid, 50)) == 6


def test_linear_grid_brute_force(spark, table, numbers):
    x, y = numbers
    df = table.withColumn("fold", F.expr("id % 4"))
    grid = {"all": ["a", "b", "c"], "two": ["a", "c"], "none": []}
    got = {(r["configuration"], r["fold"]): r for r in linear_grid.linear_grid(df.repartition(5), "y", grid).collect()}
    pen = {(r["configuration"], r["fold"]): r for r in linear_grid.linear_grid(
        df, "y", {"all": ["a", "b", "c"]}, alpha=3.0, scaled={"all": True}).collect()}
    fold = np.arange(200) % 4
    for name, cols in grid.items():
        z = np.column_stack([np.ones(200), *[x[:, "abc".index(c)] for c in cols]])
        for f in range(4):
            w = np.linalg.lstsq(z[fold != f], y[fold != f], rcond=None)[0]
            res = y[fold == f] - z[fold == f] @ w
            assert got[name, f]["mse"] == pytest.approx((res ** 2).mean(), rel=1e-8)
            assert got[name, f]["r2_score"] == pytest.approx(1 - (res ** 2).mean() / y[fold == f].var(), rel=1e-8)
    for f in range(4):
        xt, yt = x[fold != f], y[fold != f]
        m, s = xt.mean(0), xt.std(0)
        w = np.linalg.solve(((xt - m) / s).T @ ((xt - m) / s) + 3.0 * np.eye(3), ((xt - m) / s).T @ (yt - yt.mean()))
        res = y[fold == f] - yt.mean() - ((x[fold == f] - m) / s) @ w
        assert pen["all", f]["mse"] == pytest.approx((res ** 2).mean(), rel=1e-8)

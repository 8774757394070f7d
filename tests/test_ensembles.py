"""Stacking and bagging, their unwrapping, and pipelines taken apart as trees."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ablaspark.operators import configs, learners, stages, steps
from ablaspark.operators.configs import AblationConfig
from ablaspark.plans.pipelines import Step, ablate_stages, build
from ablaspark.session import concurrently


@pytest.fixture(scope="module")
def three_classes(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [2, 2], [-2, 2]])
    rows = [(i, *map(float, centres[i % 3] + rng.normal(size=2)), float(i % 3)) for i in range(360)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    return stages.assemble(["a", "b"]).transform(df).cache()


def accuracy(predictions):
    return predictions.agg(F.avg(F.expr("cast(prediction = label as double)"))).first()[0]


def members():
    return [("tree", learners.forest(trees=3, depth=3)), ("lr", learners.logistic(1.0, 50))]


def test_stack_of_three_classes(three_classes):
    train, test = three_classes.where("id % 4 != 0"), three_classes.where("id % 4 = 0")
    model = learners.Stacking(members(), ids=["id"], folds=3).stage().fit(train)
    out = model.transform(test)
    assert accuracy(out) > 0.8 and set(test.columns) <= set(out.columns) and not [c for c in out.columns if c.startswith("__")]
    first = out.select(vector_to_array("probability").alias("p"), vector_to_array("features").alias("f")).first()
    assert len(first["p"]) == 3 and sum(first["p"]) == pytest.approx(1) and len(first["f"]) == 2
    # the final learner saw three probabilities of each of two members
    assert model.detail["final"].coefficientMatrix.numCols == 6


def test_members_never_predict_rows_that_they_saw(spark):
    """A member that remembers its rows would make the final learner trust it blindly."""
    seen = []

    class Memory:
        def hasParam(self, _):
            return False

        def fit(self, df):
            known = {r["id"] for r in df.select("id").collect()}
            seen.append(known)
            return stages.ApplyStage(lambda d: d.withColumn(
                "prediction", F.when(F.col("id").isin(sorted(known)), F.lit(1.0)).otherwise(F.lit(0.0))))

    class Final:
        def fit(self, df):
            self.inputs = sorted(r[0] for r in df.select(vector_to_array("features")[0]).collect())
            return stages.ApplyStage(lambda d: d.withColumn("prediction", vector_to_array("features")[0]))

    df = stages.assemble(["x"]).transform(spark.range(60).selectExpr("id", "cast(id as double) as x", "cast(id as double) as label"))
    final = Final()
    model = learners.Stacking([("m", Memory())], final, "regression", folds=4, ids=["id"]).stage().fit(df.repartition(7))
    assert final.inputs == [0.0] * 60
    assert len(seen) == 5 and sum(60 - len(s) for s in seen) == 60 and {r[0] for r in model.transform(df).select("prediction").collect()} == {1.0}


def test_stacked_regression_beats_its_members(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, size=(300, 2))
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=300) / 10
    df = stages.assemble(["a", "b"]).transform(spark.createDataFrame(
        [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id int, a double, b double, label double")).cache()
    train, test = df.where("id % 3 != 0"), df.where("id % 3 = 0")
    error = lambda m: m.fit(train).transform(test).agg(F.avg(F.expr("power(prediction - label, 2)"))).first()[0]
    parts = [("linear", learners.linear()), ("forest", learners.forest("regression", trees=10, depth=4))]
    stack = learners.Stacking(parts, task="regression", ids=["id"], passthrough=True)
    assert error(stack.stage()) < min(error(m) for _, m in parts)


def test_draws_are_poisson_and_follow_the_row(spark):
    df = spark.range(20000).withColumn("x", F.rand(1)).cache()
    bag = learners.Bagging(learners.forest(trees=1), ids=["id"])
    draw = lambda d, i: {r["id"]: r["w"] for r in d.select("id", bag.draws(d, i).alias("w")).collect()}
    one = draw(df, 0)
    assert one == draw(df.repartition(13).drop("x"), 0) and one != draw(df, 1)
    counts = np.bincount(np.array(list(one.values()), int), minlength=5) / 20000
    assert np.allclose(counts[:5], [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.012)
    two = draw(df, 1)
    pair = np.corrcoef([one[i] for i in range(20000)], [two[i] for i in range(20000)])[0, 1]
    assert abs(pair) < 0.03


def test_bags(three_classes, spark):
    train, test = three_classes.where("id % 4 != 0"), three_classes.where("id % 4 = 0")
    bag = learners.Bagging(learners.forest(trees=1, depth=4, featureSubsetStrategy="all"), members=5, ids=["id"])
    model = bag.stage().fit(train)
    out = model.transform(test)
    assert accuracy(out) > 0.8 and abs(model.detail["oob_score"] - accuracy(out)) < 0.12
    assert sum(out.select(vector_to_array("probability").alias("p")).first()["p"]) == pytest.approx(1)
    reg = learners.Bagging(learners.forest("regression", trees=1, depth=4), 4, "regression", ["id"])
    assert reg.stage().fit(train).detail["oob_score"] > 0.4
    with pytest.raises(TypeError, match="weight"):
        learners.Bagging(learners.logistic(1.0)).stage()


def test_unwrapping():
    tree, lr = learners.forest(trees=2), learners.logistic(1.0)
    search = learners.grid_search(tree, {"maxDepth": [1, 2]})
    off = AblationConfig("off", use_hyperparam_tuning=False, use_ensembling=False)
    left = lambda model, config=off: ablate_stages([Step("model", model)], config)[0].stage
    assert left(learners.Stacking([("a", lr)], final=tree)) is tree
    assert left(learners.Stacking([("a", lr), ("b", tree)])) is lr
    assert left(learners.Bagging(tree)) is tree
    nested = learners.Stacking([("a", lr)], final=learners.Voting([("s", search), ("l", lr)]))
    assert left(nested) is tree
    assert left(nested, AblationConfig("t", use_hyperparam_tuning=False)) is nested
    assert left(nested, AblationConfig("e", use_ensembling=False)) is search


def test_an_ensemble_is_a_step_of_a_pipeline(three_classes):
    fitted = build(lambda c: [("clf", learners.Stacking(members(), ids=["id"], folds=2))], AblationConfig("full")).fit(three_classes)
    assert accuracy(fitted.transform(three_classes)) > 0.8


def test_tree_of_a_pipeline(spark):
    schema = "pipeline int, node int, parent int, pos int, role string, class string, name string"
    rows = [(1, 0, None, 0, "step", "GridSearchCV", "clf"), (1, 1, 0, 0, "estimator", "GridSearchCV", "g"), (1, 2, 1, 0, "estimator", "SVC", "s"),
            (2, 0, None, 0, "step", "GridSearchCV", "model")]  # a search without its estimator stays
    got = steps.ablate_pipelines(spark.createDataFrame(rows, schema), configs.standard_configs()).collect()
    assert {(r["pipeline"], r["class"]) for r in got if r["configuration"] == "minimal"} == {(1, "SVC"), (2, "GridSearchCV")}
    assert len(got) == 12 and steps.ablate_pipelines(spark.createDataFrame([], schema), configs.standard_configs()).count() == 0
    circle = spark.createDataFrame([*rows, (3, 0, None, 0, "step", "GridSearchCV", "m_model"), (3, 0, 0, 0, "estimator", "GridSearchCV", "x")], schema)
    with pytest.raises(Exception, match="deeper"):
        steps.MOST_NESTING, old = 3, steps.MOST_NESTING
        try:
            steps.ablate_pipelines(circle, [AblationConfig("t", use_hyperparam_tuning=False)])
        finally:
            steps.MOST_NESTING = old


def test_broken_lines_are_rejected(spark):
    lines = ['{"name": "a"', "", "null", '{"name": "b", "use_scaling": false}', '[1]', '{"name": null}']
    good, bad = configs.read_configs(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string"))
    assert [(r["name"], r["scaler_type"]) for r in good.collect()] == [("b", "none")]
    assert sorted(r["reasons"][0] for r in bad.collect()) == ["no name"] + ["not a JSON object"] * 5


def test_concurrent_tasks_keep_order_and_raise():
    assert concurrently([lambda i=i: concurrently([lambda: i, lambda: -i], 2) for i in range(9)]) == [[i, -i] for i in range(9)]
    with pytest.raises(ZeroDivisionError):
        concurrently([lambda: 1, lambda: 1 / 0])

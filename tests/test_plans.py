"""Pipelines that come apart, ablation runs, refinement."""

import pytest
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from ablaspark.operators import learners, stages
from ablaspark.operators.configs import standard_configs
from ablaspark.plans import ablation, pipelines, refinement
from ablaspark.plans.pipelines import Step

CONFIGS = {c.name: c for c in standard_configs()}
COLS = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(240).selectExpr(
        "id", "cast(pmod(hash(id), 1000) / 500.0D - 1 as double) as a", "cast(pmod(hash(id, 7), 1000) as double) as b"
    ).withColumn("label", F.expr("cast(a + pmod(hash(id, 9), 100) / 400.0D > 0.1 as double)")).cache()


def builder(config):
    search = learners.grid_search(learners.forest(trees=3), {"maxDepth": [1, 2]}, "accuracy", folds=2)
    return [
        Step("preprocessor", inner=[("imputer", stages.impute(COLS)), ("scaler", stages.scale(COLS))]),
        Step("vector", stages.assemble(COLS, "raw")),
        Step("feature_engineering", stages.variance_pca("raw", "features"),
             without=stages.ApplyStage(lambda d: d.withColumn("features", F.col("raw")))),
        Step("model", learners.Voting([("rf", search), ("lr", learners.logistic(1.0, 20))], "hard")),
    ]


def test_switching_components_off(spark):
    steps = pipelines.as_steps(builder(CONFIGS["full"]))
    off = {n: {s.name: s for s in pipelines.ablate_stages(steps, c)} for n, c in CONFIGS.items()}
    assert [n for n, _ in off["full"]["preprocessor"].inner] == ["imputer", "scaler"]
    assert [n for n, _ in off["no_scaling"]["preprocessor"].inner] == ["imputer"]
    assert isinstance(off["no_feature_engineering"]["feature_engineering"].stage, stages.ApplyStage)
    assert isinstance(off["no_ensemble"]["model"].stage, learners.CrossValidator)
    alone = [Step("model", learners.grid_search(learners.forest(trees=3), {"maxDepth": [1]}))]
    assert not isinstance(pipelines.ablate_stages(alone, CONFIGS["no_tuning"])[0].stage, learners.CrossValidator)
    only = [Step("preprocessor", inner=[("scaler", stages.scale(COLS))])]
    assert pipelines.ablate_stages(only, CONFIGS["no_scaling"]) == []


def test_builders_may_return_several_shapes(spark):
    assert pipelines.as_steps(StandardScaler())[0].name == "model"
    assert [s.name for s in pipelines.as_steps([("x", StandardScaler())])] == ["x"]
    assert pipelines.as_steps({"note": "n", "p": StandardScaler()})[0].name == "model"
    with pytest.raises(TypeError):
        pipelines.as_steps([("x", object())])
    with pytest.raises(TypeError):
        pipelines.as_steps({"note": "n"})
    with pytest.raises(KeyError, match="available"):
        pipelines.registered("nope")
    with pytest.raises(TypeError):
        pipelines.register_pipeline("x", 3)


def test_holdout_runs(spark, table):
    pipelines.register_pipeline("small", builder)
    plan = [CONFIGS["full"], CONFIGS["minimal"]]
    runs = ablation.run_holdout(table, ["id"], "label", "small", plan, n_runs=2)
    rows = runs.where("metric = 'accuracy'").collect()
    assert {(r["configuration"], r["run"], r["random_state"]) for r in rows} == {
        (c, i + 1, 42 + i) for c in ("baseline", "full", "minimal") for i in range(2)}
    best = {r["configuration"]: r["value"] for r in rows if r["run"] == 1}
    assert best["minimal"] > best["baseline"]
    assert ablation.primary_metric(runs) == "accuracy"
    assert runs.where("metric = 'train_time' and value > 0").count() == 6


def test_failed_fit_leaves_no_row_and_cv_says_so(spark, table):
    def broken(config):
        return [Step("model", stages.LearnStage(lambda df: 1 / 0))]

    assert ablation.run_holdout(table, ["id"], "label", broken, [CONFIGS["full"]], n_runs=1, baseline=False).count() == 0
    cv = ablation.run_cv(table, ["id"], "label", broken, [CONFIGS["full"]], folds=2)
    rows = {r["config_name"]: r for r in cv.collect()}
    assert rows["full"]["status"] == "failed" and "ZeroDivision" in rows["full"]["error"] and rows["full"]["mean_accuracy"] is None
    assert rows["baseline"]["status"] == "success" and rows["baseline"]["mean_accuracy"] > 0.4
    assert rows["baseline"]["use_scaling"] is False and rows["full"]["use_scaling"] is True
    with pytest.raises(ValueError, match="available"):
        ablation.run_cv(table, ["id"], "label", broken, [CONFIGS["full"]], scoring=["nope"])
    only = ablation.run_cv(table, ["id"], "label", broken, [CONFIGS["full"]], folds=2, scoring=["f1_weighted"])
    assert "mean_f1_weighted" in only.columns and "mean_accuracy" not in only.columns


def test_regression_runs(spark, table):
    def linear(config):
        return [Step("vector", stages.assemble(["a"])), Step("model", learners.linear(label="b"))]

    cv = ablation.run_cv(table, ["id"], "b", linear, [CONFIGS["full"]], folds=3, task="regression").collect()
    assert {r["config_name"] for r in cv} == {"baseline", "full"} and all(r["std_mean_squared_error"] >= 0 and r["mean_root_mean_squared_error"] > 0 for r in cv)
    runs = ablation.run_holdout(table, ["id"], "b", linear, [CONFIGS["full"]], n_runs=1, task="regression")
    assert ablation.primary_metric(runs) == "r2_score"
    with pytest.raises(ValueError):
        ablation.primary_metric(runs.where("metric = 'mae'"))


def test_sanity_matrix(spark, table):
    def unbuildable(config):
        raise ValueError("cannot build")

    def unfit(config):
        return [Step("model", learners.forest(trees=2))]  # no features column

    rows = ablation.sanity_matrix(spark, {"good": builder, "bad": unbuildable, "odd": unfit}, table, table,
                                  [CONFIGS["minimal"]]).collect()
    assert {r["builder"]: r["status"] for r in rows} == {"good": "OK", "bad": "FAIL", "odd": "EXC"}


def test_times_are_positive(spark, table):
    pipeline = pipelines.build(lambda c: [Step("v", stages.assemble(COLS)), Step("model", learners.forest(trees=2))], CONFIGS["full"])
    assert all(s > 0 for s in ablation.fit_predict_time(pipeline, table, table))


def test_refinement_and_candidates(spark, table):
    train, test = table.where("id % 4 != 0"), table.where("id % 4 = 0")
    rows = refinement.refine_component(train, test, COLS, rfe_keep=1).collect()
    assert {r["component"] for r in rows} == {"scaler", "selector"} and sum(r["best"] for r in rows) == 2
    for component in ("scaler", "selector"):
        mine = [r for r in rows if r["component"] == component]
        assert max(r["score"] for r in mine) == next(r["score"] for r in mine if r["best"])
    parts = stages.assemble(COLS)
    fitted, scores = refinement.candidate_models(parts.transform(train), parts.transform(test), searches={
        "forest": learners.forest(trees=3), "logistic": learners.logistic(1.0, 20)})
    assert len(fitted) == 2 and scores.count() == 2
    best = refinement.ensemble_scores(fitted, scores, parts.transform(test)).first()
    assert best["best_score"] == max(best["voting_score"], best["weighted_score"])
    rows = refinement.feature_ablation(train, test, COLS, trees=5, top=2).collect()
    assert [r["removed"] for r in rows][:2] == ["(none)", "a"] and rows[1]["drop"] > 0


def test_step_names_are_made_canonical():
    from pyspark.ml.feature import PCA, Imputer, StandardScaler
    from pyspark.ml.classification import RandomForestClassifier

    def built(config):
        return [pipelines.Step("scaler", inner=(("imputer", Imputer()), ("scaler", StandardScaler()))),
                pipelines.Step("feature_pipeline", inner=(("pca", PCA()),)), pipelines.Step("estimator", RandomForestClassifier()),
                pipelines.Step("clf", RandomForestClassifier())]

    steps = pipelines.canonical_steps(pipelines.as_steps(built(None)))
    assert [s.name for s in steps] == ["preprocessor", "feature_engineering", "model", "model_1"]
    count = lambda name: len(pipelines.build(built, CONFIGS[name]).getStages())
    assert count("full") == 5 and count("no_scaling") == 4 and count("no_feature_engineering") == 4


def test_three_classes_vote_and_auc(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from ablaspark.operators.learners import Voting

    rows = [(i, float(i % 3), float(i % 3) + (i % 7) / 20) for i in range(90)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "id bigint, label double, x double"))
    members = [("a", LogisticRegression(regParam=0.01)), ("b", LogisticRegression(regParam=0.1))]
    for kind in ("soft", "hard"):
        predictions = Voting(members, kind).stage().fit(df).transform(df)
        values = ablation.score(predictions, "classification")
        assert values["accuracy"] > 0.95
        assert (values["roc_auc"] > 0.99) if kind == "soft" else (values["roc_auc"] is None)
    assert ablation.score(ablation.baseline_predictions(df, df, "classification", "label"), "classification")["roc_auc"] == 0.5


def test_a_holdout_study_computes_its_features_once(spark):
    """They were computed once for the split of every run."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(x):
        calls.add(1)
        return float(x)

    rows = [(i, float(i % 2), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, label double, x double").withColumn("x", feature("x"))
    got = ablation.run_holdout(df, ["id"], "label", lambda config: [], configs=[], n_runs=3)
    assert {r["run"] for r in got.collect()} == {1, 2, 3} and calls.value == 200
    assert not df.is_cached


def test_rows_of_deep_forests_remember_their_nodes(spark):
    """Without it each round of a deep forest sent all trees to all tasks; the trees are the same."""
    rows = [(float(hash((i, 1)) % 97), float(hash((i, 2)) % 89), float(hash((i, 3)) % 5 > 2)) for i in range(600)]
    train = stages.assemble(["a", "b"]).transform(spark.createDataFrame(rows, "a double, b double, label double"))
    deep = learners.forest(trees=4, depth=None)
    assert deep.getCacheNodeIds() and not learners.forest().getCacheNodeIds()
    plain = learners.forest(trees=4, depth=None, cacheNodeIds=False)
    assert deep.fit(train).toDebugString.split("\n")[1:] == plain.fit(train).toDebugString.split("\n")[1:]

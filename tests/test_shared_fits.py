"""Pipelines that begin alike share their fits."""

import threading

import pytest
from pyspark.errors import AnalysisException

from ablaspark.operators import learners, stages
from ablaspark.plans import ablation
from ablaspark.plans.ablation import broken_configuration, fit_together
from ablaspark.operators.configs import standard_configs


def counting(log, name, key, fails=None):
    def learn(df):
        if fails:
            raise fails
        log.append((name, threading.current_thread().name))
        return stages.FittedStage(lambda d: d.withColumn(name, d["x"] + 1))

    return stages.LearnStage(learn, name, key)


def test_equal_prefixes_are_fitted_once(spark):
    log, df = [], spark.range(20).selectExpr("id as x")
    plans = {
        "full": [counting(log, "a", (1,)), counting(log, "b", (1,)), counting(log, "c", (1,))],
        "same": [counting(log, "a", (1,)), counting(log, "b", (1,)), counting(log, "c", (1,))],
        "other_end": [counting(log, "a", (1,)), counting(log, "b", (1,)), counting(log, "d", (1,))],
        "other_start": [counting(log, "a", (2,)), counting(log, "b", (1,))],
        "short": [counting(log, "a", (1,))],
        "unkeyed": [counting(log, "a", None)],
        "broken": [counting(log, "a", (1,)), counting(log, "e", (1,), ValueError("no"))],
    }
    done = fit_together(plans, df, df)
    assert sorted(n for n, _ in log) == ["a", "a", "a", "b", "b", "c", "d"]
    assert isinstance(done["broken"][0], ValueError) and set(done) == set(plans)
    assert {n: p.columns for n, (p, _) in done.items() if n != "broken"} == {
        "full": ["x", "a", "b", "c"], "same": ["x", "a", "b", "c"], "other_end": ["x", "a", "b", "d"], "other_start": ["x", "a", "b"],
        "short": ["x", "a"], "unkeyed": ["x", "a"]}
    assert done["full"][1] > done["short"][1] > 0
    with pytest.raises(OSError):
        fit_together({"lost": [counting(log, "f", None, OSError("executor lost"))]}, df, df)


def test_keys_tell_stages_apart():
    key = stages.stage_key
    assert key(learners.forest(trees=3)) == key(learners.forest(trees=3)) != key(learners.forest(trees=4))
    assert key(stages.scale(["a"])) == key(stages.scale(["a"])) != key(stages.scale(["a"], "minmax"))
    vote = lambda c: learners.Voting([("a", learners.logistic(c)), ("b", learners.forest())]).stage()
    assert key(vote(1.0)) == key(vote(1.0)) != key(vote(2.0))
    search = lambda d: learners.grid_search(learners.forest(), {"maxDepth": [d]})
    assert key(search(1)) != key(search(2))


def test_missing_files_are_not_the_configurations_fault(spark):
    with pytest.raises(AnalysisException) as missing:
        spark.read.parquet("/nowhere/at/all")
    with pytest.raises(AnalysisException) as column:
        spark.range(1).select("nope")
    assert not broken_configuration(missing.value) and broken_configuration(column.value)
    assert not broken_configuration(RuntimeError("set spark.checkpoint.dir"))


def test_shared_study_equals_single_runs(spark):
    df = spark.range(160).selectExpr("id", "cast(id % 7 as double) as a", "cast(id * 37 % 11 as double) as b",
                                     "cast(id % 7 > 3 as double) as label")

    def builder(config):
        return [("scaler", stages.scale(["a", "b"])), ("assemble", stages.assemble(["a", "b"])),
                ("model", learners.Voting([("lr", learners.logistic(1.0, 20)), ("rf", learners.forest(trees=2, depth=2))]))]

    every = ablation.run_holdout(df, ["id"], "label", builder, standard_configs(), n_runs=1)
    for config in standard_configs()[::2]:
        alone = ablation.run_holdout(df, ["id"], "label", builder, [config], n_runs=1, baseline=False).where("metric != 'train_time'")
        shared = every.where(f"metric != 'train_time' and configuration = '{config.name}'")
        assert sorted(map(tuple, alone.select("metric", "value").collect())) == sorted(map(tuple, shared.select("metric", "value").collect()))

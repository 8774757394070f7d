"""What a feature ablation computes once, and in how many tasks its deep forests are fitted."""

import random

import pytest
from pyspark.sql import functions as F

from ablaspark.operators import learners
from ablaspark.plans import refinement


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double").withColumn(
        "label", (F.col("a") + F.col("b") / 2 > 0.7).cast("double")).repartition(8, "id")


def test_a_feature_ablation_computes_its_columns_once(spark, table):
    """They were computed several times for every fit."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(x):
        calls.add(1)
        return x

    df = table.withColumn("a", feature("a"))
    train, test = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    rows = refinement.feature_ablation(train, test, ["a", "b", "c"], trees=3, top=2).collect()
    assert [r["removed"] for r in rows] == ["(none)", "a", "b"] and rows[1]["drop"] > 0
    assert calls.value == 400
    assert not train.is_cached and not test.is_cached


def test_deep_forests_of_an_ablation_are_fitted_in_few_tasks_and_side_by_side(table, monkeypatch):
    """Every partition was a task of its own that sent statistics of all nodes, and a refit waited for the one before."""
    parts, widths = [], []
    train, test = table.where("id % 4 != 0"), table.where("id % 4 = 0")
    forest, side_by_side = learners.forest, refinement.concurrently

    def watched(**options):
        made = forest(**options)
        fit = made.fit
        made.fit = lambda df: parts.append(df.rdd.getNumPartitions()) or fit(df)
        return made

    monkeypatch.setattr(learners, "forest", watched)
    monkeypatch.setattr(refinement, "concurrently", lambda tasks, n: widths.append((len(tasks), n)) or side_by_side(tasks, n))
    refinement.feature_ablation(train, test, ["a", "b", "c"], trees=2, top=2).collect()
    assert parts == [1, 1, 1] and widths == [(2, 2)]
    monkeypatch.setattr(refinement, "ROW_TREES", 500)
    refinement.feature_ablation(train, test, ["a", "b", "c"], trees=2, top=2, depth=3).collect()
    assert min(parts[3:]) > 1 and widths[1:] == [(2, 1)]


def test_few_tasks_keep_all_rows_and_give_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(learners, "FEWEST", 100)
    few = learners.in_few_tasks(table, 400)
    assert few.rdd.getNumPartitions() == 3 and sorted(few.collect()) == sorted(table.collect())
    assert max(few.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 200
    monkeypatch.setattr(learners, "MOST", 80)
    assert learners.in_few_tasks(table, 400).rdd.getNumPartitions() == 5
    one = table.coalesce(1)
    assert learners.in_few_tasks(one, 400) is one
    assert learners.in_few_tasks(table, 0).rdd.getNumPartitions() == 1

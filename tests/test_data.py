"""Profiling, cleaning, scaling, selection, metrics and votes on small tables."""

import math

import pytest

from ablaspark.operators import cleaning, features, metrics, profiling, voting


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, 1.0, "b", 1), (2, None, "a", 0), (3, float("nan"), None, 1), (4, 4.0, "b", None), (5, 10.0, "c", 0)]
    return spark.createDataFrame(rows, "id int, x double, c string, y int")


def test_profile_counts_nan_and_null(gaps):
    row = profiling.profile_table(gaps).first()
    assert (row["n_rows"], row["n_columns"], row["missing_cells"]) == (5, 4, 4)


def test_drop_missing(gaps):
    assert [r["id"] for r in cleaning.drop_missing_rows(gaps, ["x"], "y").collect()] == [1, 5]


def test_cap_infinite_only_when_present(spark, gaps):
    assert cleaning.cap_infinite(gaps, ["x"]) is gaps
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,), (float("nan"),), (1.5,)], "x double")
    big = 1.7976931348623157e308
    assert [r["x"] for r in cleaning.cap_infinite(df, ["x"]).collect()] == [big, -big, 0.0, 0.0, 1.5]


def test_median_fit_on_train_only(gaps):
    filled = cleaning.fill_median(gaps, ["x"], fit_on=gaps.where("id <= 4"))
    assert [r["x"] for r in filled.orderBy("id").collect()] == [1.0, 2.5, 2.5, 4.0, 10.0]


def test_label_encode_null_is_a_text(gaps):
    got = {r["id"]: r["c"] for r in cleaning.label_encode(gaps, "c").collect()}
    assert got == {1: 1, 2: 0, 3: 3, 4: 1, 5: 2}  # a, b, c, nan


def test_interactions_skip_absent(gaps):
    out = cleaning.interaction_terms(gaps, {"p": ("id", "y"), "none": ("id", "zzz")})
    assert "p" in out.columns and "none" not in out.columns
    with pytest.raises(ValueError, match="zzz"):
        cleaning.drop_columns(gaps, ["zzz"])


def test_task_type(spark):
    df = spark.range(100).selectExpr("id", "id % 20 as k", "cast(id % 2 as double) as f")
    kinds = {t: profiling.infer_task_type(df, t).first()["task_type"] for t in df.columns}
    assert kinds == {"id": "regression", "k": "classification", "f": "regression"}
    assert profiling.infer_task_type(df, "id", forced="classification").first()["task_type"] == "classification"


def test_leakage(spark):
    train = spark.range(50).selectExpr("cast(id as double) as label", "cast(3 * id + 1 as double) as copy",
                                       "cast(hash(id) as double) as noise", "1.0D as const", "id as date",
                                       "if(id = 3, null, cast(id as double)) as gap")
    rows = {(r["check"], r["column"]) for r in profiling.leakage_check(train, train.drop("noise"), "label").collect()}
    assert rows == {("target_correlation", "copy"), ("target_correlation", "date"), ("time_column", "date"),
                    ("column_mismatch", "noise")}


def test_dataset_info_rejects_floats(spark):
    with pytest.raises(ValueError, match="discrete"):
        profiling.dataset_info(spark.createDataFrame([(1.0, "train")], "y double, split string"), "y", [])


def test_scalers_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, c double")
    std = features.fit_scaler(df, ["x", "c"]).transform(df).collect()
    assert [r["c"] for r in std] == [0.0] * 4
    sd = math.sqrt(sum((v - 4) ** 2 for v in (1, 2, 3, 10)) / 4)
    assert std[3]["x"] == pytest.approx(6 / sd)
    robust = features.fit_scaler(df, ["x"], "robust").transform(df).collect()
    assert robust[0]["x"] == pytest.approx((1 - 2.5) / (4.75 - 1.75))
    assert features.fit_scaler(df, ["x"], "none").transform(df).collect() == df.collect()
    with pytest.raises(ValueError):
        features.fit_scaler(df, ["x"], "other")


def test_imputers(gaps):
    got = features.fit_imputer(gaps, ["c", "x"], "most_frequent").transform(gaps).orderBy("id").collect()
    assert [r["c"] for r in got] == ["b", "a", "b", "b", "c"] and got[1]["x"] == 1.0
    mean = features.fit_imputer(gaps, ["x"]).transform(gaps).orderBy("id").collect()
    assert mean[1]["x"] == mean[2]["x"] == 5.0


def test_f_scores_ties_keep_the_later_column(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2 * 3 + i % 3), float(i % 2 * 3 + i % 3), float(i % 5)) for i in range(60)],
                               "y int, a double, b double, c double")
    assert [r["column"] for r in features.select_k_best(df, "y", ["a", "b", "c"], 1).collect()] == ["b"]


def test_published_confusion_counts(spark):
    cells = [(0, 0, 454), (0, 1, 2), (1, 0, 20), (1, 1, 58)]
    df = spark.createDataFrame([(y, p) for y, p, n in cells for _ in range(n)], "y int, p int")
    b = metrics.binary_metrics(df, "y", "p").first()
    assert [round(b[k], 4) for k in ("f1_score", "accuracy", "precision", "recall")] == [.8406, .9588, .9667, .7436]
    assert round(metrics.macro_metrics(df, "y", "p").first()["f1_score"], 2) == .91
    assert round(metrics.classification_metrics(df, "y", "p").first()["f1_score"], 2) == .96
    m = {r["label"]: (r["p_0"], r["p_1"]) for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert m == {0: (454, 2), 1: (20, 58)}


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "y string, p string")
    rows = {r["class"]: r for r in metrics.per_class_metrics(metrics.confusion_counts(df, "y", "p")).collect()}
    assert rows["a"]["precision"] == 0.0 and rows["b"]["recall"] == 0.0 and rows["b"]["support"] == 0


def test_r2_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first()["r2_score"] == 0.0


def test_repeat_cv_skips_failed_runs(spark):
    rows = [("a", 1, .5), ("a", 1, .7), ("a", 2, None), ("a", 2, .9), ("b", 1, None)]
    got = {r["c"]: r for r in metrics.repeat_cv(spark.createDataFrame(rows, "c string, run int, s double"), "s", ["c"]).collect()}
    assert (got["a"]["score_mean"], got["a"]["n_runs"]) == (pytest.approx(.6), 1)
    assert (got["b"]["score_mean"], got["b"]["score_std"], got["b"]["n_runs"]) == (0.0, 0.0, 0)


def test_votes(spark):
    df = spark.createDataFrame([(2, 1, 1), (3, 2, 1), (0, 0, 5)], "a int, b int, c int")
    assert [r["vote"] for r in voting.vote_hard(df, ["a", "b", "c"]).collect()] == [1, 1, 0]
    p = spark.createDataFrame([(.6, .4, .2, .8)], "a0 double, a1 double, b0 double, b1 double")
    members = [["a0", "a1"], ["b0", "b1"]]
    assert voting.vote_soft(p, members, [0, 1]).first()["vote"] == 1
    assert voting.vote_soft(p, members, [0, 1], [1.0, None]).first()["vote"] == 0
    assert voting.vote_soft(p, members, [0, 1], voting.member_weights([.1, .2])).first()["vote"] is None
    # One member: hard and soft agree.
    one = voting.vote_soft(p, members[:1], [0, 1]).first()["vote"]
    assert one == voting.vote_hard(p.selectExpr("if(a1 > a0, 1, 0) as m"), ["m"]).first()["vote"]


def test_best_ensemble_needs_strictly_better(spark):
    df = spark.createDataFrame([(.5, .5), (.5, .6), (.5, None)], "voting_score double, weighted_score double")
    assert [r["best_ensemble"] for r in voting.best_ensemble(df).collect()] == [
        "voting_ensemble", "weighted_ensemble", "voting_ensemble"]

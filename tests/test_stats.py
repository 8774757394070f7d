"""Statistics against hand-worked and published result tables."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ablaspark.operators import comparing, hypothesis, metrics, summaries
from ablaspark.plans.reporting import statistical_report
from ablaspark.session import cut_lineage

# Published rows: experiment, best mean, best std, full mean, full std, effect, label.
EFFECTS = [
    ("cls_breast_cancer", .955702, .016218, .948684, .017376, "Small"),
    ("cls_iris", .963333, .028408, .908333, .049412, "Large"),
]


def table(spark, scores):
    rows = [(c, i, r, float(v)) for i, (c, vs) in enumerate(scores.items()) for r, v in enumerate(vs)]
    return spark.createDataFrame(rows, "configuration string, cfg_ord int, run int, value double").withColumn(
        "experiment", F.lit("e"))


def test_published_interval(spark):
    df = spark.createDataFrame([(.955702, .016218, 20)], "mean double, std double, n bigint")
    row = summaries.with_interval(df, "n").first()
    assert row["ci_lower"] == pytest.approx(.948111, abs=2e-6) and row["ci_upper"] == pytest.approx(.963292, abs=2e-6)


def test_published_effects(spark):
    df = spark.createDataFrame([e[:5] for e in EFFECTS], "e string, m double, s double, fm double, fs double")
    d = hypothesis.pooled_d("m", "s", "20", "fm", "fs", "20")
    rows = df.selectExpr("e", f"{d} as d").selectExpr("e", "d", f"{hypothesis.effect_label('d', True)} as l").collect()
    assert {r["e"]: r["l"] for r in rows} == {e[0]: e[5] for e in EFFECTS}
    assert [round(r["d"], 2) for r in rows if r["e"] == "cls_iris"] == [1.36]


def test_interval_undefined_for_constant_and_single(spark):
    df = table(spark, {"const": [0.5] * 4, "one": [0.7], "two": [0.1, 0.3]})
    rows = {r["configuration"]: r for r in summaries.summarize_statistics(df, "value", ["configuration"]).collect()}
    assert rows["const"]["ci_lower"] is None and rows["const"]["std"] == 0.0
    assert rows["one"]["std"] is None and rows["one"]["ci_upper"] is None
    assert rows["two"]["ci_lower"] == pytest.approx(0.2 - 12.7062047 * 0.1, abs=1e-6)


def test_paired_test_by_hand(spark):
    a, b = [0.9, 0.8, 0.85, 0.95], [0.7, 0.75, 0.8, 0.8]
    pairs = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    row = hypothesis.paired_t_test(pairs).first()
    d = [x - y for x, y in zip(a, b)]
    t = statistics.mean(d) / (statistics.stdev(d) / 2)
    assert row["t_statistic"] == pytest.approx(t)
    # closed form of the two-sided tail for three degrees of freedom
    th = math.atan(t / math.sqrt(3))
    assert row["p_value"] == pytest.approx(1 - 2 / math.pi * (th + math.sin(th) * math.cos(th)), abs=1e-12)


def test_paired_test_degenerate(spark):
    same = hypothesis.paired_t_test(spark.createDataFrame([(1.0, 1.0)] * 3, "a double, b double")).first()
    assert same["t_statistic"] is None and same["p_value"] is None and same["significant"] is False
    shifted = hypothesis.paired_t_test(spark.createDataFrame([(2.0, 1.0)] * 3, "a double, b double")).first()
    assert math.isinf(shifted["t_statistic"]) and shifted["p_value"] == 0.0 and shifted["significant"] is True


def test_anova_degenerate_and_hand(spark):
    df = table(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 3.0, 4.0], "c": [5.0, 6.0, 7.0]})
    row = hypothesis.anova_test(df, "value", "configuration").first()
    assert row["f_statistic"] == pytest.approx(13.0) and row["n_groups"] == 3
    # d1 = 2: p = (1 + 2 F / d2)^(-d2 / 2)
    assert row["p_value"] == pytest.approx((1 + 26 / 6) ** -3, rel=1e-10)
    flat = table(spark, {"a": [1.0, 1.0], "b": [1.0, 1.0]})
    assert hypothesis.anova_test(flat, "value", "configuration").first()["p_value"] is None


def test_pairwise_direction_and_symmetry(spark):
    rng = random.Random(1)
    scores = {c: [rng.random() for _ in range(6)] for c in ("full", "zeta", "alpha")}
    df = table(spark, scores)
    rows = hypothesis.pairwise_comparison(df, ["experiment"], order="cfg_ord").collect()
    assert {(r["config_a"], r["config_b"]) for r in rows} == {("full", "zeta"), ("full", "alpha"), ("zeta", "alpha")}
    assert all(r["corrected_alpha"] == pytest.approx(0.05 / 3) for r in rows)
    back = hypothesis.pairwise_comparison(df.withColumn("rev", F.expr("-cfg_ord")), ["experiment"], order="rev").collect()
    there = {(r["config_a"], r["config_b"]): r for r in rows}
    for r in back:
        other = there[r["config_b"], r["config_a"]]
        assert r["cohen_d"] == pytest.approx(-other["cohen_d"]) and r["p_value"] == pytest.approx(other["p_value"])
    plain = hypothesis.pairwise_comparison(df, ["experiment"], order="cfg_ord", correction="none")
    assert "corrected_alpha" not in plain.columns


def test_t_to_z_clips(spark):
    df = spark.createDataFrame([(50.0, 0.0), (-1.0, 1.0), (None, 0.5)], "t double, p double")
    z = [r[0] for r in df.select(F.expr(hypothesis.t_to_z("t", "p"))).collect()]
    assert z[0] == pytest.approx(7.0345, abs=1e-3) and z[1] == pytest.approx(0.0) and z[2] is None


def test_bonferroni(spark):
    df = spark.createDataFrame([(0.01,), (0.3,), (None,), (0.9,)], "p_value double")
    rows = hypothesis.bonferroni(df).orderBy(F.asc_nulls_last("p_value")).collect()
    assert rows[0]["bonferroni_significant"] and rows[2]["corrected_p"] == pytest.approx(3.6)
    assert rows[3]["bonferroni_significant"] is False
    with pytest.raises(ZeroDivisionError):
        hypothesis.bonferroni(df.where("false"))


def test_report_tables(spark):
    df = table(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 3.0, 4.5], "c": [5.0, 6.0, 7.0]})
    report = statistical_report(df, ["experiment"], "cfg_ord")
    assert report["summary"].count() == 3 and report["anova"].count() == 1 and report["pairwise"].count() == 3
    two = statistical_report(df.where("configuration != 'c'"), ["experiment"], "cfg_ord")
    assert two["anova"].count() == 0 and two["pairwise"].count() == 1


def test_missing_baseline_is_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        comparing.compare_to_baseline(table(spark, {"a": [1.0]}), "value", "nope", config="configuration")


def test_stars_and_labels(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.02,), (0.2,), (None,)], "p double")
    assert [r[0] for r in df.select(F.expr(hypothesis.p_stars("p"))).collect()] == ["***", "**", "*", "ns", "—"]


def test_box_and_effects_use_exact_medians(spark):
    df = cut_lineage(spark.range(1, 102).selectExpr("cast(id as double) as value", "'g' as g"))
    row = summaries.box_stats(df.union(spark.createDataFrame([(1000.0, "g")], df.schema)), "value", ["g"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (26.25, 51.5, 76.75)
    assert row["whisker_high"] == 101.0 and row["n_outliers"] == 1


def test_nested_metrics(spark):
    df = spark.createDataFrame([("t", "train", 1.0), ("t", "train", 3.0), ("t", "ensemble", 5.0)],
                               "task string, artifact_type string, metric_value double")
    nested = summaries.nest_by_task(summaries.metric_by_task_type(df)).first()["metrics"]
    assert nested["train"]["mean"] == 2.0 and nested["ensemble"]["count"] == 1
    with pytest.raises(ValueError, match="metric_value"):
        summaries.metric_by_task_type(df.drop("metric_value"))


def test_best_vs_full_needs_the_pair(spark):
    rng = random.Random(2)
    df = table(spark, {c: [rng.random() for _ in range(5)] for c in ("full", "minimal", "baseline")})
    summary = summaries.summarize_statistics(df, "value", ["experiment", "configuration"])
    pairs = hypothesis.pairwise_comparison(df, ["experiment"], order="cfg_ord")
    row = comparing.best_vs_full(summary, pairs, ["experiment"]).first()
    pair = pairs.where("config_a = 'full' and config_b = 'minimal'").first()
    assert row["best_config"] == "minimal" and row["cohens_d"] == pytest.approx(-pair["cohen_d"])
    with pytest.raises(Exception, match="no pairwise row"):
        comparing.best_vs_full(summary, pairs.where("config_b != 'minimal'"), ["experiment"]).collect()


def test_ranks_and_corrections_without_groups(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "y", 4.0), ("e", "x", None), ("e", "y", 2.0), ("e", "z", -1.0)],
                               "experiment string, configuration string, score double")
    got = {(r["experiment"], r["configuration"]): (r["rank"], r["best_vs_worst"])
           for r in metrics.rank_metrics(df, "score", ["experiment"]).collect()}
    assert got == {(None, "y"): (1, 3.0), (None, "x"): (2, 3.0), ("e", "y"): (1, 3.0), ("e", "x"): (2, 3.0), ("e", "z"): (3, 3.0)}
    whole = metrics.rank_metrics(df.where("experiment is null or configuration = 'z'"), "score").orderBy("rank").collect()
    assert [r["configuration"] for r in whole] == ["y", "x", "z"]
    assert metrics.rank_metrics(df.limit(0), "score").count() == 0
    runs = spark.createDataFrame([(c, r, float(r * k)) for k, c in enumerate("abc") for r in range(4)],
                                 "configuration string, run int, value double")
    alphas = [r["corrected_alpha"] for r in hypothesis.pairwise_comparison(runs, []).collect()]
    assert alphas == pytest.approx([0.05 / 3] * 3)

"""Bucketed ranks and bracketed quantiles against brute force, with hot keys and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablaspark.operators import metrics, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}",
             0.25 if rng.random() < 0.35 else round(rng.gauss(0, 10), rng.choice([0, 3])), i) for i in range(5000)]
    rows += [("inf", float("inf"), 5001), ("inf", 1.0, 5002), ("inf", float("-inf"), 5003), (None, 2.0, 5004),
             (None, 4.0, 5005), ("nan", float("nan"), 5006), ("nan", 3.0, 5007)]
    return rows, spark.createDataFrame(rows, "g string, v double, id bigint").repartition(7)


@pytest.mark.parametrize("accuracy,bins", [(10_000, 1024), (50, 8)])
def test_exact_quantiles_by_group(skewed, accuracy, bins):
    rows, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in ordering.exact_quantiles(df, "v", probs, ["g"], accuracy, bins).collect()}
    groups = {}
    for g, v, _ in rows:
        if not np.isnan(v):
            groups.setdefault(g, []).append(v)
    assert len(got) == len(groups) * len(probs)
    for (g, p), q in got.items():
        if g == "inf":
            continue
        assert q == pytest.approx(float(np.quantile(groups[g], p)), rel=1e-12, abs=1e-12)
    assert got["inf", 0.5] == 1.0 and got["inf", 1.0] == float("inf")


def test_quantiles_plain_form_agrees(skewed):
    rows, df = skewed
    clean = df.where("g like 'g%' or g = 'hot'")
    got = {(r["g"], r["p"]): r["q"] for r in ordering.exact_quantiles(clean, "v", [0.3, 0.5], ["g"]).collect()}
    for (g, p), q in got.items():
        assert q == pytest.approx(float(np.quantile([v for x, v, _ in rows if x == g], p)))
    (one,) = ordering.exact_quantiles(clean, "v", [0.5]).collect()
    assert one["q"] == pytest.approx(float(np.median([v for g, v, _ in rows if g and (g[0] == "g" or g == "hot")])))


def test_rank_keeps_decimals_apart(spark):
    from decimal import Decimal
    rows = [(Decimal(100000000000000000 + k),) for k in (3, 1, 5, 2, 4)]
    df = spark.createDataFrame(rows, "v decimal(38,0)").repartition(3)
    got = {int(r["v"]) % 10: r["rank"] for r in ordering.ordered_rank(df, ["v"], "rank").collect()}
    assert got == {k: k for k in range(1, 6)}


def test_rank_with_ties_and_hot_group(skewed):
    rows, df = skewed
    clean = [(g, v, i) for g, v, i in rows if g and g not in ("nan", "inf")]
    ranked = ordering.ordered_rank(df.where("g not in ('nan', 'inf')"), ["-v", "id"], "rank", ["g"]).collect()
    assert len(ranked) == len(clean)
    want = {}
    for g in {g for g, _, _ in clean}:
        for n, (_, _, i) in enumerate(sorted((-v, i, i) for x, v, i in clean if x == g), 1):
            want[i] = n
    assert {r["id"]: r["rank"] for r in ranked} == want


def test_rank_of_texts(spark):
    words = sorted({f"{chr(97 + i % 26)}'{i}\\é" for i in range(700)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["n"] for r in ordering.ordered_rank(df, ["w"], "n").collect()}
    assert got == {w: n for n, w in enumerate(words, 1)}


def test_rank_does_not_depend_on_partitions(skewed):
    _, df = skewed
    base = df.where("g = 'hot'")
    one = {(r["id"], r["n"]) for r in ordering.ordered_rank(base.coalesce(1), ["v", "id"], "n").collect()}
    many = {(r["id"], r["n"]) for r in ordering.ordered_rank(base.repartition(40), ["v", "id"], "n").collect()}
    assert one == many


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_brute_force(spark):
    rng = random.Random(5)
    rows = [("a", 0.5 if rng.random() < 0.4 else rng.random(), rng.randrange(2)) for _ in range(600)]
    rows += [("b", rng.random(), 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "s", by=["g"]).collect()}
    assert got["a"] == pytest.approx(brute_auc([(s, y) for g, s, y in rows if g == "a"])) and got["b"] is None
    flipped = metrics.roc_auc(df.where("g = 'a'").withColumn("s", F.expr("-s")), "y", "s").first()[0]
    assert flipped == pytest.approx(1 - got["a"])


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, i) for i in range(300)] + [("a", i) for i in range(50)], "g string, id int")
    got = ordering.ordered_rank(df, ["id"], "n", ["g"]).where("n != id + 1").count()
    assert got == 0 and ordering.ordered_rank(df, ["id"], "n", ["g"]).count() == 350

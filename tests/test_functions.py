"""Distribution tails against published values."""

import math

import pytest
from pyspark.sql import functions as F

from ablaspark.functions import safe, tails


def values(spark, rows, schema, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_t_tail_table(spark):
    rows = [(2.093024, 19.0), (2.776445, 4.0), (12.7062, 1.0), (4.302653, 2.0)]
    for (p,) in values(spark, rows, "t double, v double", tails.t_two_sided("t", "v")):
        assert p == pytest.approx(0.05, abs=1e-7)


def test_t_tail_edges(spark):
    rows = [(0.0, 5.0), (-1.5, 4.0), (1.5, 4.0), (None, 4.0), (1.0, 0.0), (1.0, 1.0)]
    got = [p for (p,) in values(spark, rows, "t double, v double", tails.t_two_sided("t", "v"))]
    assert got[0] == 1.0 and got[1] == got[2] == pytest.approx(0.208) and got[3] is None and got[4] is None
    assert got[5] == pytest.approx(0.5)


@pytest.mark.parametrize("v", [10.0, 1e3, 1e6, 1e9])
def test_t_tail_large_degrees_meet_normal(spark, v):
    (p,), = values(spark, [(2.0, v)], "t double, v double", tails.t_two_sided("t", "v"))
    normal = math.erfc(2.0 / math.sqrt(2))
    # first correction term of the t tail: phi(t) * t (t^2 + 1) / (2 v)
    gap = 2 * math.exp(-2) / math.sqrt(2 * math.pi) * 2 * 5 / (4 * v)
    assert p == pytest.approx(normal + gap, rel=2 / v + 1e-7)


def test_t_quantile(spark):
    # Two-sided 5 % and 0.1 % critical values from the usual tables.
    rows = [(1.0, 12.7062, 636.619), (2.0, 4.30265, 31.5991), (3.0, 3.18245, 12.9240), (4.0, 2.77645, 8.61030),
            (19.0, 2.09302, 3.88341), (120.0, 1.97993, 3.37345)]
    got = values(spark, rows, "v double, a double, b double", tails.t_upper_ppf(0.025, "v"), "a",
                 tails.t_upper_ppf(0.0005, "v"), "b")
    for q5, a, q01, b in got:
        assert q5 == pytest.approx(a, rel=1e-5) and q01 == pytest.approx(b, rel=1e-5)


def test_f_tail(spark):
    rows = [(3.098391, 3.0, 20.0), (2.293911, 5.0, 114.0), (4.380750, 1.0, 19.0)]
    for (p,) in values(spark, rows, "f double, a double, b double", tails.f_sf("f", "a", "b")):
        assert p == pytest.approx(0.05, abs=1e-6)
    more = values(spark, [(0.2, 2.0, 10.0), (50.0, 6.0, 133.0), (0.0, 2.0, 5.0), (1.0, 2e6, 2e6)],
                  "f double, a double, b double", tails.f_sf("f", "a", "b"))
    assert more[0][0] == pytest.approx(0.82193, abs=1e-5)
    assert more[1][0] == pytest.approx(9.13e-32, rel=1e-3)
    assert more[2][0] == 1.0 and more[3][0] == pytest.approx(0.5, abs=1e-6)


def test_f_equals_squared_t(spark):
    rows = [(t / 3, float(v)) for t in range(1, 30) for v in (1, 2, 7, 40)]
    for a, b in values(spark, rows, "t double, v double", tails.t_two_sided("t", "v"), tails.f_sf("t * t", "1", "v")):
        assert a == pytest.approx(b, rel=1e-10)


def test_normal_quantile(spark):
    rows = [(0.975, 1.959963984540054), (1e-10, -6.361340902404056), (0.5, 0.0), (0.3, -0.5244005127080407),
            (0.9, 1.2815515655446004), (1 - 1e-12, 7.034483825301131)]
    for z, want in values(spark, rows, "p double, z double", tails.norm_ppf("p"), "z"):
        assert z == pytest.approx(want, abs=1e-4 if abs(want) > 7 else 1e-12)


def test_safe_forms(spark):
    got = values(spark, [(1.0, 0.0)], "a double, b double", safe.ratio("a", "b"), safe.ratio0("a", "b"),
                 safe.real("double('NaN')"))
    assert got == [(None, 0.0, None)]


def test_pearson_undefined_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 2.0)],
                               "x double, y double, c double, g double")
    row = df.agg(F.expr(safe.pearson("x", "y")), F.expr(safe.pearson("x", "c")), F.expr(safe.pearson("x", "g"))).first()
    assert row[0] == pytest.approx(1.0) and row[1] is None and row[2] is None


def test_t_quantile_of_many_degrees_of_freedom(spark):
    """Newton steps on the tail never got small here: the query ended with an error."""
    degrees = [9_999, 10_000, 148_000, 888_300, 2_222_222, 55_000_000, 10**9]
    df = spark.createDataFrame([(n,) for n in degrees], "n bigint")
    for tail in (0.05, 0.025, 0.0005):
        got = df.selectExpr("n", f"{tails.t_upper_ppf(tail, 'n')} as t").selectExpr("n", "t", f"{tails.t_two_sided('t', 'n')} / 2 as p").collect()
        ordered = [r["t"] for r in sorted(got, key=lambda r: r["n"])]
        assert len(ordered) == len(degrees) and ordered == sorted(ordered, reverse=True)
        assert all(r["p"] == pytest.approx(tail, rel=1e-6) for r in got)
        assert all(r["p"] == pytest.approx(tail, rel=1e-10) for r in got if r["n"] <= 10_000)

import math

import pytest
from pyspark.sql import functions as F

from tallymark.functions.numeric import chi2_upper_tail, log_gamma, pearson, ratio, total


@pytest.mark.parametrize("x, dof, p", [
    (3.84, 1, 0.0500435), (4.5, 4, 0.3425475), (100.0, 100, 0.4811917), (0.0, 3, 1.0),
    (1000.0, 4, 0.0), (None, 2, None)])
def test_chi2_tail(spark, x, dof, p):
    df = spark.createDataFrame([(x, float(dof))], "x double, d double")
    got = df.select(chi2_upper_tail(F.col("x"), F.col("d"))).first()[0]
    assert got is None if p is None else got == pytest.approx(p, abs=1e-7)


def test_chi2_tail_closed_form_and_many_degrees(spark):
    data = [(2 * h, 2 * a) for a in (1, 3, 10, 60) for h in (0.1, 1.0, a - 0.5, a + 3.0, 2.0 * a)]
    df = spark.createDataFrame([(float(x), float(d)) for x, d in data], "x double, d double")
    for r in df.select("x", "d", chi2_upper_tail(F.col("x"), F.col("d")).alias("p")).collect():
        h, a = r["x"] / 2, int(r["d"] / 2)
        want = sum(math.exp(-h + k * math.log(h) - math.lgamma(k + 1)) for k in range(a))
        assert r["p"] == pytest.approx(want, abs=1e-11)
    many = spark.createDataFrame([(1e8, 1e8), (1e8 + 4e4, 1e8)], "x double, d double")
    p = [r[0] for r in many.select(chi2_upper_tail(F.col("x"), F.col("d"))).collect()]
    assert p[0] == pytest.approx(0.5, abs=1e-3) and p[1] == pytest.approx(0.00234, abs=2e-4)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 10.0, 55.5, 1e4, 1e8]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", log_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)


def test_degenerate_ratios(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None)], "x double, y double")
    one = df.agg(pearson("x", "y"), pearson("x", "x"), ratio(F.sum("x"), F.lit(0)),
                 total(F.when(F.lit(False), F.col("x")))).first()
    assert (one[0], one[2], one[3]) == (None, None, 0.0)
    assert one[1] == pytest.approx(1.0)

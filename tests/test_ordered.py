import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.operators import ordered

floats = st.floats(allow_nan=False, allow_infinity=False, width=64,
                   min_value=-1e300, max_value=1e300)


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def quantiles(df, probabilities):
    out = ordered.exact_quantiles(df, ["v"], probabilities).collect()
    return {r["probability"]: r["value"] for r in out}


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(4000, 17.25), rng.lognormal(5, 2, 5000),
                             -rng.lognormal(1, 1, 3000), [0.0, 1e12, -1e12]])
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles(frame(spark, values), probabilities)
    want = np.quantile(values, probabilities)
    assert [got[p] for p in probabilities] == pytest.approx(list(want), rel=1e-12)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(floats, min_size=1, max_size=30))
def test_median_matches_numpy(spark, values):
    assert quantiles(frame(spark, values), [0.5])[0.5] == pytest.approx(
        float(np.quantile(np.array(values), 0.5)), rel=1e-9, abs=1e-300)


def test_quantiles_by_group_with_null_keys_and_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), (None, 7.0), (None, 100.0),
         ("b", None), ("c", float("nan")), ("c", 4.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in ordered.exact_median(df, "v", ["k"]).collect()}
    assert got == {"a": 1.5, None: 7.0, "c": 4.0}


def test_quantiles_of_nothing(spark):
    assert quantiles(frame(spark, []), [0.5]) == {}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(2)
    values = np.round(np.concatenate([rng.normal(0, 1, 500), np.full(300, 0.5)]), 2)
    got = ordered.running_totals(frame(spark, values), "v", {"n": F.lit(1)},
                                 descending=descending).collect()
    for r in got:
        upto = (values >= r["v"]) if descending else (values <= r["v"])
        assert r["cum_n"] == upto.sum() and r["n"] == (values == r["v"]).sum()
    assert len(got) == len(np.unique(values))


def test_running_totals_by_group_and_extremes(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 2.0), ("x", float("inf")), ("x", 3.0), ("x", -float("inf")),
         ("x", None)], "k string, v double")
    got = {(r["k"], r["v"]): r["cum_n"]
           for r in ordered.running_totals(df, "v", {"n": F.lit(1)}, ["k"]).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("x", -math.inf): 1, ("x", 3.0): 2,
                   ("x", math.inf): 3}


def test_buckets_follow_the_order_and_stay_small(spark):
    """Also for 20,000 scores below 1e-13, which absolute steps would put together."""
    rng = np.random.default_rng(5)
    crowded = np.unique(rng.random(20_000) * 2e-14)
    powers = np.concatenate([[np.nextafter(2.0 ** k, 0), 2.0 ** k, np.nextafter(2.0 ** k, 9e99)]
                             for k in range(-1040, 300, 7)])
    values = np.unique(np.concatenate([crowded, powers, -powers, [0.0, 5e-324, 1e308, -1e308]]))
    rows = frame(spark, values).withColumn("b", ordered.leaf_bucket(F.col("v"))).orderBy("v").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets)
    df = frame(spark, crowded).withColumn("b0", ordered.leaf_bucket(F.col("v")))
    assert df.groupBy("b0").count().agg(F.max("count")).first()[0] <= 256
    for level in range(ordered.TOP):
        up = df.select(ordered.parent(F.col("b0"), level + 1).alias("up"),
                       ordered.parent(F.col("b0"), level).alias("b")).distinct()
        assert up.groupBy("up").count().agg(F.max("count")).first()[0] <= 65_536
    got = ordered.running_totals(frame(spark, crowded), "v", {"n": F.lit(1)}).collect()
    assert sorted(r["cum_n"] for r in got) == list(range(1, len(crowded) + 1))


def test_ranks_survive_a_second_evaluation(spark):
    """The values differ in the last bit each time they are evaluated; no rank may be null."""
    df = spark.range(50).select(F.col("id"), (F.col("id") + F.rand()).alias("v"))
    shaken = df.withColumn("v", F.col("v") * (1 + F.expr("uuid()").substr(1, 1).isin("0", "1")
                                              .cast("double") * 1e-15))
    ranks = [r["rank"] for r in ordered.rank_rows(shaken, "v").collect()]
    assert sorted(ranks) == list(range(1, 51))


def test_ranks(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", 1.0)], "k string, v double")
    got = {r["k"]: r["rank"] for r in ordered.rank_rows(df, "v").collect()}
    assert got == {"a": 2, "b": 1, "c": 2, "d": 4}


def brute_auc(scores, labels):
    pairs = [(s, t) for s, a in zip(scores, labels) for t, b in zip(scores, labels) if a and not b]
    return sum(1.0 if s > t else 0.5 if s == t else 0.0 for s, t in pairs) / len(pairs)


def auc(spark, scores, labels):
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)],
                               "s double, y int")
    return ordered.area_under_curve(df, "s", F.col("y") == 1).first()["auc"]


def test_auc_known(spark):
    assert auc(spark, [.1, .4, .35, .8], [0, 0, 1, 1]) == 0.75
    assert auc(spark, [.1, .2], [1, 1]) is None
    assert auc(spark, [.5, .5, .5], [0, 1, 0]) == 0.5


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.random(150), np.full(80, 0.25), 0.25 + rng.random(60) * 1e-9])
    labels = rng.integers(0, 2, len(scores))
    assert auc(spark, scores, labels) == pytest.approx(brute_auc(scores, labels), rel=1e-12)

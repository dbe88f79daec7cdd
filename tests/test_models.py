import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from tallymark.learn import blocks as bl
from tallymark.learn import boosting, linear
from tallymark.operators import checks
from tallymark.operators.clean import clean
from tallymark.plans import models, saved
from tallymark.session import settings


@pytest.fixture(scope="module")
def sold(spark):
    """Returns follow the region, apart from every eleventh order."""
    i = F.col("id")
    raw = spark.range(900).select(
        F.concat(F.lit("O"), i).alias("OrderID"),
        F.make_timestamp_ntz(F.lit(2024), 1 + i % 12, 1 + i % 27, F.lit(0), F.lit(0), F.lit(0))
        .alias("Date"),
        F.make_timestamp_ntz(F.lit(2024), 1 + i % 12, 1 + i % 27, F.lit(0), F.lit(0), F.lit(0))
        .alias("OrderDate"),
        F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz").alias("DeliveryDate"),
        F.concat(F.lit("R"), i % 4).alias("Region"), F.concat(F.lit("P"), i % 5).alias("Product"),
        F.when(i % 2 == 0, "new").alias("CustomerType"), F.lit("Cash").alias("PaymentMethod"),
        F.when(i % 3 == 0, "SAVE10").alias("Promotion"),
        F.concat(F.lit("S"), i % 7).alias("StoreLocation"),
        F.concat(F.lit("Seller"), i % 300).alias("Salesperson"), F.lit("Max").alias("RegionManager"),
        (1 + i % 9).cast("int").alias("Quantity"), (10.0 + i % 37).alias("UnitPrice"),
        ((i % 4) * 0.05).alias("Discount"), (i % 13).cast("double").alias("ShippingCost"),
        F.when(i % 11 == 0, 1 - (i % 4 == 0).cast("int")).otherwise((i % 4 == 0).cast("int"))
        .alias("Returned"))
    raw = raw.withColumn("TotalPrice",
                         F.col("Quantity") * F.col("UnitPrice") * (1 - F.col("Discount")))
    return clean(raw).checkpoint()


def test_split_is_repeatable_and_stratified(sold):
    lines = sold.unionByName(sold)
    first = models.stratified(lines, "Returned").groupBy("OrderID").agg(
        F.countDistinct("is_test", "fold").alias("n"))
    assert first.where("n > 1").count() == 0
    share = models.stratified(sold, "Returned").groupBy("Returned").agg(
        F.avg(F.col("is_test").cast("int")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["s"] - 0.2) <= 1 / r["n"] for r in share)
    again = models.stratified(sold.repartition(7), "Returned").where("is_test").select("OrderID")
    assert again.exceptAll(models.stratified(sold, "Returned").where("is_test")
                           .select("OrderID")).count() == 0
    folds = models.stratified(sold, "Returned").where("not is_test").groupBy("fold").count().collect()
    assert len(folds) == 5 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 8


def test_codes_unseen_and_missing(sold):
    train = sold.where("Region <> 'R3'")
    coded = models.Features(["Region", "CustomerType"], ["Quantity"]).fit(train).coded(sold)
    region = {r[0]: r[1] for r in coded.select("Region", "Region_code").distinct().collect()}
    assert region == {"R0": 0.0, "R1": 1.0, "R2": 2.0, "R3": 3.0}
    kind = {r[0]: r[1] for r in coded.select("CustomerType", "CustomerType_code")
            .distinct().collect()}
    assert kind == {"nan": 0.0, "new": 1.0}


def test_many_levels_are_coded_alike(sold):
    coded = models.Features(["Salesperson"], ["Quantity"]).fit(sold).coded(sold)
    found = [r[0] for r in coded.select("Salesperson_code", "Salesperson").distinct()
             .orderBy("Salesperson").collect()]
    assert found == [float(i) for i in range(300)]


def test_scaled_features(sold):
    enc = models.Features(["Region"], ["Quantity", "UnitPrice"]).fit(sold)
    one = enc.coded(sold).agg(*[f(c) for c in enc.inputs for f in (F.avg, F.stddev_samp)]).first()
    assert list(enc.scaler().mean) == pytest.approx(list(one[::2]))
    assert list(enc.scaler().std) == pytest.approx(list(one[1::2]))


def in_blocks(data):
    held = [bl.Block(r.asDict()) for r in data.blocks.collect()]
    return [np.concatenate([getattr(b, k) for b in held], -1) for k in ("x", "z", "y", "part")]


def test_linear_regression_has_its_closed_form(sold):
    fitted = models.RevenueModels(sold, names=["Linear Regression"])
    _, z, y, part = in_blocks(fitted.data)
    x = np.concatenate([z, np.ones((1, len(y)))]).T
    want = x @ np.linalg.lstsq(x[part != bl.TEST], y[part != bl.TEST], rcond=None)[0]
    got = fitted.predictions["Linear Regression"].select("prediction").collect()
    assert sorted(r[0] for r in got) == pytest.approx(sorted(want[part == bl.TEST]), rel=1e-6, abs=1e-6)


def test_return_models(sold):
    fitted = models.ReturnModels(sold, trees=5, folds=2, forest_depth=5)
    board = {r["model"]: r for r in fitted.leaderboard().collect()}
    assert len(board) == 5 and sum(r["is_best"] for r in board.values()) == 1
    base = board[models.MAJORITY]
    assert base["auc"] == 0.5 and 0.5 < base["accuracy"] < 1
    for name in fitted.models:
        r = board[name]
        assert r["cv_auc"] > 0.65 and r["auc"] > 0.65, name
    assert [r["no_signal"] for r in board.values() if r["is_best"]] == [False]
    assert board[fitted.best]["cv_auc"] == max(r["cv_auc"] for r in board.values() if r["cv_auc"])
    top = fitted.importances("Decision Tree", 3).collect()
    assert len(top) == 3 and top[0]["feature"] in ("Region", "Discount", "DiscountBucket")
    assert fitted.importances("Logistic Regression") is None
    assert fitted.class_report().count() == 4 and fitted.confusion().count() == 4
    assert fitted.roc_points().select("model").distinct().count() == 4


def test_forest_of_full_depth_finds_the_returns(sold):
    fitted = models.ReturnModels(sold, trees=20, folds=2, names=["Random Forest"])
    r = fitted.leaderboard().where("is_best").first()
    assert r["cv_auc"] > 0.75 and r["auc"] > 0.75


def slow_auc(label, score):
    up, down = score[label == 1], score[label == 0]
    return np.mean([[(a > b) + 0.5 * (a == b) for b in down] for a in up])


def columns(df, *names):
    return np.array([list(r) for r in df.select(*names).collect()], float).T


def slow_ranking(names, shares):
    top = sorted(zip(names, shares), key=lambda p: (-p[1], p[0]))[:10]
    return [(f, pytest.approx(v, abs=1e-12), i + 1) for i, (f, v) in enumerate(top)]


def slow_logistic(z, y, penalty=1.0):
    """Plain gradient descent with momentum until the slope is gone."""
    x = np.concatenate([z, np.ones((1, len(y)))])
    hold = np.append(np.full(len(z), penalty), 0.0)
    w = v = np.zeros(len(x))
    rate = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + penalty)
    for _ in range(4000):
        slope = x @ (1 / (1 + np.exp(-(w @ x))) - y) + hold * w
        v = 0.9 * v - rate * slope
        w = w + v
    return w


def test_results_of_the_models_in_full(spark, sold, monkeypatch):
    fitted = models.ReturnModels(sold, trees=3, folds=2, forest_depth=4,
                                 names=["Logistic Regression", "Random Forest"])
    sales = models.RevenueModels(sold, trees=3, forest_depth=4,
                                 names=["Linear Regression", "Random Forest"])
    monkeypatch.setattr(registered, "return_models", lambda s, d, names=None, cross=True: fitted)
    monkeypatch.setattr(registered, "revenue_models", lambda s, d, names=None: sales)
    monkeypatch.setattr(registered, "input_bytes", lambda *a: 1)
    monkeypatch.setattr(registered, "tune", lambda *a: None)
    run = {name: query(spark, "") for name, query in registered.model_results().items()}

    board = {r["model"]: r for r in run["clf_scores"].collect()}
    x, z, y, part = in_blocks(fitted.data)
    one = np.concatenate([z, np.ones((1, len(y)))])
    sides = [(part != bl.TEST, part == bl.TEST)] + [
        ((part != bl.TEST) & (part != k), part == k) for k in (0, 1)]
    plain = [(y[test], linear.probability(slow_logistic(z[:, train], y[train]) @ one[:, test]))
             for train, test in sides]
    saved = [columns(fitted.scored.where(f"name = 'Random Forest' AND model = {m}"), "label", "score")
             for m in range(3)]
    cross = {}
    for name, results in (("Logistic Regression", plain), ("Random Forest", saved)):
        label, score = results[0]
        guess = score > 0.5
        hit = ((label == 1) & guess).sum()
        assert board[name]["accuracy"] == pytest.approx((label == guess).mean())
        assert board[name]["f1_returned"] == pytest.approx(2 * hit / (label.sum() + guess.sum()))
        assert board[name]["auc"] == pytest.approx(slow_auc(label, score), abs=1e-6)
        cross[name] = board[name]["cv_auc"]
        assert cross[name] == pytest.approx(np.mean([slow_auc(*r) for r in results[1:]]), abs=1e-6)
    assert [n for n, r in board.items() if r["is_best"]] == [max(cross, key=cross.get)]

    board = {r["model"]: r for r in run["reg_scores"].collect()}
    for name in sales.models:
        label, guess = columns(sales.predictions[name], "label", "prediction")
        error = label - guess
        assert board[name]["mae"] == pytest.approx(np.abs(error).mean())
        assert board[name]["rmse"] == pytest.approx(np.sqrt((error ** 2).mean()))
        assert board[name]["r2"] == pytest.approx(
            1 - (error ** 2).sum() / ((label - label.mean()) ** 2).sum())

    got = [tuple(r) for r in run["return_importance"].collect()]
    assert got == slow_ranking(fitted.data.features.names, fitted.models["Random Forest"].importances())
    got = [tuple(r) for r in run["revenue_importance"].collect()]
    assert got == (slow_ranking(sales.data.features.names, sales.models[sales.best].importances())
                   if sales.best == "Random Forest" else [])


@pytest.mark.parametrize("family", ["returns", "revenue"])
def test_loaded_models_score_like_fitted_ones(spark, sold, tmp_path, family):
    make = models.ReturnModels if family == "returns" else models.RevenueModels
    fitted = make(sold, trees=4, **({"cross": False} if family == "returns" else {}))
    test = fitted.data.rows.where("is_test")
    shown = "score" if family == "returns" else "prediction"
    for name in fitted.models:
        version = saved.save_model(fitted, name, f"{tmp_path}/{name}")
        model = saved.load_model(spark, f"{tmp_path}/{name}")
        got = model.score(test)
        assert model.about["version"] == version
        assert got.columns[:len(test.columns)] == test.columns
        want = fitted.predictions[name].select("label", shown).collect()
        assert sorted(map(tuple, got.select("label", "score").collect())) == [
            (pytest.approx(a), pytest.approx(b)) for a, b in sorted(map(tuple, want))], name
        if family == "returns":
            assert got.where((F.col("score") > 0.5) != (F.col("prediction") == 1)).count() == 0
        # Levels that were not there in training, and null, have a score, too.
        odd = test.limit(3).withColumns({"Region": F.lit("nowhere"), "Product": F.lit(None).cast("string")})
        assert model.score(odd).where("score IS NOT NULL").count() == 3
        assert model.score(odd).first()["Region"] == "nowhere"
    broken = test.withColumn("UnitPrice", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="null or NaN"):
        saved.load_model(spark, f"{tmp_path}/{name}").score(broken).collect()


def test_folds_equal_separate_fits(sold):
    """A fold's model is the one that is fitted to the other folds alone."""
    data = models.ReturnModels(sold, trees=3, folds=3, names=["Decision Tree"]).data
    whole = boosting.fit_boosted(data.blocks, 4, 4, 3, 0.1, True)
    for fold in range(3):
        kept = models.materialise(data.coded.where(F.col("part") != fold), "without")
        alone = bl.make_blocks(kept, data.features.inputs, data.cuts, data.scale.mean, data.scale.std,
                               900, "OrderID")
        one = boosting.fit_boosted(alone, 1, 4, 3, 0.1, True)
        for block in (bl.Block(r.asDict()) for r in data.blocks.collect()):
            assert one.raw(block, 0) == pytest.approx(whole.raw(block, fold + 1))


def test_no_signal_is_flagged(sold):
    noise = sold.withColumn("Returned", (F.xxhash64("OrderID") % 2 == 0).cast("int"))
    board = models.ReturnModels(noise, folds=3, names=["Logistic Regression"]).leaderboard()
    assert board.where("is_best").first()["no_signal"]


def test_revenue_models(sold):
    assert checks.is_identity(sold).first()["target_leakage"]
    fitted = models.RevenueModels(sold, trees=10, forest_depth=6)
    board = {r["model"]: r for r in fitted.leaderboard().collect()}
    assert len(board) == 3 and board[fitted.best]["r2"] == max(r["r2"] for r in board.values())
    assert all(r["r2"] > 0.6 and r["mae"] <= r["rmse"] for r in board.values())
    assert {r["feature"] for r in fitted.importances("Random Forest", 2).collect()} == \
        {"Quantity", "UnitPrice"}
    assert set(fitted.actual_vs_predicted().columns) == {"label", "prediction"}


def test_a_null_number_is_an_error_not_a_lost_row(sold):
    broken = sold.withColumn("UnitPrice", F.when(F.col("Quantity") > 1, F.col("UnitPrice")))
    with pytest.raises(Exception):
        models.RevenueModels(broken, trees=2, names=["Linear Regression"])


def test_only_linear_models_get_scaled_values(sold):
    """Scaled values took most of the bytes of the blocks that boosting and forests read."""
    boosted = models.RevenueModels(sold, trees=2, names=["Gradient Boosting"])
    assert boosted.data.blocks.where("z IS NOT NULL").count() == 0
    both = models.RevenueModels(sold, trees=2, names=["Linear Regression", "Gradient Boosting"])
    assert both.data.blocks.where("z IS NULL").count() == 0
    assert boosted.importances("Gradient Boosting").collect() == both.importances("Gradient Boosting").collect()


def test_sales_are_not_shuffled_again_for_the_split(spark):
    """They lie by order when joined, which the join with the places by label and order can use."""
    def exchanges() -> int:
        split = registered.prepared(spark, "/root/testdata/sf0.001")._split
        return split._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, plain):
        before = exchanges()
        with settings(spark, models.SUBSET_KEYS):
            assert exchanges() < before

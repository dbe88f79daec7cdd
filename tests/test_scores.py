import numpy as np
import pytest

from tallymark.operators import scores

from conftest import rows


@pytest.fixture
def predicted(spark):
    return spark.createDataFrame([(0, 0, .1), (0, 0, .4), (1, 0, .35), (1, 1, .8), (0, 1, .8)],
                                 "label int, prediction int, score double")


def test_confusion_lists_empty_cells(spark, predicted):
    assert rows(scores.confusion(predicted), "label", "prediction") == [
        (0, 0, 2), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    ones = spark.createDataFrame([(1, 1)], "label int, prediction int")
    assert rows(scores.confusion(ones), "label", "prediction") == [
        (0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)]


def test_class_report(predicted):
    got = {r["class"]: tuple(r)[1:] for r in scores.class_report(predicted).collect()}
    assert got["0"] == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3))
    assert got["1"] == pytest.approx((1 / 2, 1 / 2, 1 / 2, 2))
    assert got["macro avg"] == pytest.approx((7 / 12, 7 / 12, 7 / 12, 5))
    assert got["weighted avg"] == pytest.approx((.6, .6, .6, 5))


def test_class_report_undefined_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in scores.class_report(df).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1)


def test_roc_points(predicted):
    got = [(r["threshold"], r["tp"], r["fp"], r["tpr"]) for r in
           scores.roc_points(predicted).orderBy("threshold").collect()]
    assert got == [(.1, 2, 3, 1.0), (.35, 2, 2, 1.0), (.4, 1, 2, .5), (.8, 1, 1, .5)]
    assert scores.roc_points(predicted, bins=2).count() == 2
    assert scores.accuracy(predicted).first()[0] == pytest.approx(.6)
    assert scores.majority_share(predicted).first()[0] == pytest.approx(.6)


def test_regression_metrics(spark):
    rng = np.random.default_rng(0)
    y, p = rng.normal(10, 3, 60), rng.normal(10, 3, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)],
                               "label double, prediction double")
    one = scores.regression_metrics(df).first()
    assert one["mae"] == pytest.approx(np.abs(y - p).mean())
    assert one["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert one["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert scores.regression_metrics(flat).first()["r2"] is None

"""Model metrics computed from tables of labels, predictions and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numeric import ratio
from tallymark.operators.ordered import accumulate, area_under_curve, value_totals

LABELS = [0, 1]


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def auc(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    return area_under_curve(df, score, F.col("label") == 1, by)


def roc_points(df: DataFrame, score: str = "score", bins: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score, highest first.

    Rows with the same score share a point. The result has as many rows as
    there are distinct scores; `bins` floors the scores onto a grid of that
    many steps per unit to keep a plot small.
    """
    if bins:
        df = df.withColumn(score, F.floor(F.col(score) * bins) / F.lit(float(bins)))
    positive = (F.col("label") == 1).cast("bigint")
    totals = value_totals(df.where(F.col("label").isNotNull()), score,
                          {"positives": positive, "negatives": 1 - positive})
    points = accumulate(totals, score, ["positives", "negatives"], descending=True)
    whole = totals.agg(F.struct(F.sum("positives").alias("p"),
                                F.sum("negatives").alias("n"))).scalar()
    return points.select(
        F.col(score).alias("threshold"), F.col("cum_positives").alias("tp"),
        F.col("cum_negatives").alias("fp"),
        ratio(F.col("cum_positives"), whole["p"]).alias("tpr"),
        ratio(F.col("cum_negatives"), whole["n"]).alias("fpr"))


def confusion(df: DataFrame) -> DataFrame:
    """Counts for all four label and prediction pairs, zeros included."""
    label, predicted = F.col("label").cast("int"), F.col("prediction").cast("int")
    one = df.agg(*[F.count_if((label == a) & (predicted == p)).alias(f"n_{a}_{p}")
                   for a in LABELS for p in LABELS])
    listed = [F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"),
                       F.col(f"n_{a}_{p}").alias("lines")) for a in LABELS for p in LABELS]
    return one.select(F.explode(F.array(*listed)).alias("r")).select("r.*")


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages.

    A metric whose denominator is 0 counts as 0.
    """
    c = F.col

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    label, predicted = c("label").cast("int"), c("prediction").cast("int")
    parts = []
    for k in LABELS:
        parts += [F.count_if((label == k) & (predicted == k)).alias(f"hit_{k}"),
                  F.count_if(predicted == k).alias(f"pred_{k}"),
                  F.count_if(label == k).alias(f"sup_{k}")]
    one = df.agg(*parts)
    for k in LABELS:
        one = one.withColumn(f"pr_{k}", zero(ratio(c(f"hit_{k}"), c(f"pred_{k}"))))
        one = one.withColumn(f"re_{k}", zero(ratio(c(f"hit_{k}"), c(f"sup_{k}"))))
        one = one.withColumn(f"f1_{k}", zero(ratio(2 * c(f"pr_{k}") * c(f"re_{k}"),
                                                   c(f"pr_{k}") + c(f"re_{k}"))))
    support = reduce(lambda a, b: a + b, [c(f"sup_{k}") for k in LABELS])

    def row(name: str, metric) -> Column:
        return F.struct(F.lit(name).alias("class"), metric("pr").alias("precision"),
                        metric("re").alias("recall"), metric("f1").alias("f1"))

    def mean(weight) -> object:
        return lambda m: zero(ratio(sum(c(f"{m}_{k}") * weight(k) for k in LABELS),
                                    sum(weight(k) for k in LABELS)))

    rows = [F.struct(row(str(k), lambda m, k=k: c(f"{m}_{k}")).alias("r"),
                     c(f"sup_{k}").alias("support")) for k in LABELS]
    rows += [F.struct(row("macro avg", mean(lambda k: F.lit(1.0))).alias("r"),
                      support.alias("support")),
             F.struct(row("weighted avg", mean(lambda k: c(f"sup_{k}"))).alias("r"),
                      support.alias("support"))]
    return (one.select(F.explode(F.array(*rows)).alias("x"))
            .select("x.r.*", "x.support"))


def regression_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R² of `prediction` against `label`; R² null for a constant label."""
    by = by or []
    error = F.col("label") - F.col("prediction")
    sst = F.regr_syy(F.col("label"), F.col("label"))
    return (df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"), sst.alias("_sst"))
        .withColumn("r2", 1 - ratio(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst"))


def majority_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of always predicting the most frequent class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_share"))

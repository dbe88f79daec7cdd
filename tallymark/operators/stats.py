"""Chi-square tests of return rates, correlations, trends and forecasts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numeric import chi2_upper_tail, pearson, ratio
from tallymark.learn.moments import Moments, moments
from tallymark.operators.breakdown import level_totals
from tallymark.operators.periods import monthly_filled

Z_95 = 1.96
MIN_R2 = 0.15
SIGNIFICANCE = 0.05


def chi_square(counts: DataFrame) -> DataFrame:
    """Independence test per `dim` on a table `dim`, `level`, `rated`, `returned`.

    Levels that are null or have no rows are left out. With one degree of
    freedom the statistic is continuity-corrected. If an expected count is 0
    there is no p-value; with a single level the statistic is 0 and p is 1.
    Only sums cross the network: totals have one row per dimension, and the
    dimensions are the ones the caller listed, so they are broadcast.
    """
    cells = counts.where(F.col("level").isNotNull() & (F.col("rated") > 0))
    totals = cells.groupBy("dim").agg(
        F.sum("rated").cast("double").alias("_n"), F.sum("returned").cast("double").alias("_r"),
        F.count(F.lit(1)).alias("_levels"))
    dof = (F.col("_levels") - 1).cast("int")

    def part(observed, outcome_total):
        expected = F.col("rated") * outcome_total / F.col("_n")
        off = F.abs(observed - expected)
        off = F.when(dof == 1, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
        return ratio(off * off, expected)

    kept = F.col("rated") - F.col("returned")
    rate = F.col("returned") / F.col("rated") * 100
    out = (cells.join(F.broadcast(totals), "dim")
           .groupBy("dim").agg(
               F.max(dof).alias("dof"),
               F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"),
               (F.sum(part(F.col("returned"), F.col("_r"))
                      + part(kept, F.col("_n") - F.col("_r")))).alias("_stat"),
               F.max(F.col("_r")).alias("_r"), F.max(F.col("_n")).alias("_n")))
    degenerate = (F.col("_r") == 0) | (F.col("_r") == F.col("_n"))
    stat = F.when(degenerate, None).when(F.col("dof") == 0, 0.0).otherwise(F.col("_stat"))
    out = out.withColumn("chi2", stat)
    out = out.withColumn("p_value", chi2_upper_tail(F.col("chi2"), F.col("dof").cast("double")))
    verdict = F.when(F.col("p_value") < SIGNIFICANCE, "significant").when(
        F.col("p_value").isNotNull(), "noise")
    return out.select("dim", "min_rate", "max_rate", "chi2", "dof", "p_value",
                      verdict.alias("verdict"))


def return_rate_tests(df: DataFrame, dims: list[str]) -> DataFrame:
    """Does the return rate differ between the levels of each dimension?"""
    return chi_square(level_totals(df, dims))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation matrix in long form, over complete pairs.

    All pairs come from one pass over the rows, a matrix of sums per task. `i` and `j` are
    positions, `lower` marks the cells below the diagonal. The diagonal is 1 for a column that
    varies; a constant column has no correlations.
    """
    names = list(columns)

    def cells(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                r = Moments.unpacked(data).correlations()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x in names for _ in names]), pa.array(names * len(names)),
                     pa.array([i for i in range(len(names)) for _ in names], pa.int32()),
                     pa.array(list(range(len(names))) * len(names), pa.int32()),
                     pa.array(r.ravel(), mask=np.isnan(r).ravel()),
                     pa.array([i > j for i in range(len(names)) for j in range(len(names))])],
                    ["x", "y", "i", "j", "corr", "lower"])

    return moments(df, names).mapInArrow(
        cells, "x string, y string, i int, j int, corr double, lower boolean")


def trend_fit(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least-squares line through each group's filled monthly revenue.

    r and R² are null for a constant series, slope and intercept for a single
    month (`too_short`). `sigma` is the residual deviation on n - 2 degrees.
    """
    by = by or []
    y, x = F.col("y"), F.col("x")
    spread_y = F.regr_syy(y, x)
    fit = monthly_filled(df, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        pearson("x", "y").alias("r"),
        F.when(spread_y > 0, F.regr_r2(y, x)).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
        spread_y.alias("_syy"),
        F.avg("x").alias("x_mean"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"))
    left = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    sigma = F.sqrt(left / F.greatest(F.lit(1), F.col("n") - 2))
    return (fit.withColumn("sigma", sigma)
            .withColumn("too_short", F.col("n") < 2)
            .withColumn("usable_trend", F.coalesce(F.col("r2") >= MIN_R2, F.lit(False)))
            .drop("_sxy", "_syy"))


def trend_forecast(df: DataFrame, by: list[str] | None = None, horizon: int = 6) -> DataFrame:
    """Next `horizon` months of each group's trend with a 95 % prediction interval."""
    by = by or []
    fit = trend_fit(df, by)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    x = F.col("n") - 1 + F.col("step")
    out = ahead.withColumn("x", x).withColumn(
        "ds", F.last_day(F.add_months("last_ds", F.col("step"))))
    out = out.withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("x"))
    lever = 1 + 1 / F.col("n") + ratio(F.pow(F.col("x") - F.col("x_mean"), F.lit(2.0)),
                                       F.col("sxx"))
    out = out.withColumn("band", Z_95 * F.col("sigma") * F.sqrt(lever))
    return out.select(*by, "step", "ds", "x", "yhat", "band",
                      (F.col("yhat") - F.col("band")).alias("low"),
                      (F.col("yhat") + F.col("band")).alias("high"), "r2", "usable_trend")


def forecast_width(df: DataFrame, by: list[str] | None = None, horizon: int = 6) -> DataFrame:
    """Mean half-width of the interval as a percentage of the mean forecast."""
    by = by or []
    return trend_forecast(df, by, horizon).groupBy(*by).agg(
        F.avg("yhat").alias("mean_forecast"), F.avg("band").alias("mean_band"),
        (ratio(F.avg("band"), F.avg("yhat")) * 100).alias("relative_width_pct"))

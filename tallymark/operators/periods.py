"""Monthly, quarterly and yearly series, gaps, like-for-like comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.derive import month_start, year_quarter
from tallymark.functions.numeric import ratio, total


def monthly(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Revenue per calendar month; months without sales are absent."""
    by = by or []
    return (df.groupBy(*by, month_start(F.col("Date")).alias("month"))
            .agg(total(F.col("TotalPrice")).alias("revenue"), F.count(F.lit(1)).alias("lines")))


def every_month(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The monthly series with the empty months between put in (`is_gap`).

    Each month is stretched up to the one before the next month seen, so the
    series is filled without a second pass or a join. A window holds one
    group's months, never its sales.
    """
    by = by or []
    series = monthly(df, by).where(F.col("month").isNotNull())
    following = F.lead("month").over(Window.partitionBy(*by).orderBy("month"))
    until = F.coalesce(F.add_months(following, -1), F.col("month"))
    months = F.sequence(F.col("month"), F.col("_until"), F.expr("interval 1 month"))
    return (series.withColumn("_until", until)
            .select(*by, "revenue", "lines", F.posexplode(months).alias("_p", "month"))
            .select(*by, "month", (F.col("_p") > 0).alias("is_gap"),
                    F.when(F.col("_p") == 0, F.col("revenue")).otherwise(0.0).alias("revenue"),
                    F.when(F.col("_p") == 0, F.col("lines")).otherwise(0).alias("lines")))


def monthly_filled(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Revenue per month with 0 for empty months, keyed by month end.

    `x` counts months from the group's first one.
    """
    by = by or []
    first = F.min("month").over(Window.partitionBy(*by))
    return every_month(df, by).select(
        *by, F.last_day("month").alias("ds"),
        F.months_between("month", first).cast("int").alias("x"), F.col("revenue").alias("y"))


def month_gaps(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Months without a sale between the first and the last sale, per group."""
    by = by or []
    return every_month(df, by).where("is_gap").select(*by, "month")


def rolling_mean(df: DataFrame, rows: int = 3, by: list[str] | None = None) -> DataFrame:
    """Mean of the last `rows` months of the filled series, null until there are enough."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("ds").rowsBetween(1 - rows, 0)
    return monthly_filled(df, by).withColumn(
        "rolling", F.when(F.count("y").over(w) == rows, F.avg("y").over(w)))


def monthly_trend(df: DataFrame, ticks: int = 8) -> DataFrame:
    """Sparse monthly series with the mean line and every n-th axis tick."""
    series = monthly(df).where(F.col("month").isNotNull())
    stats = series.agg(F.struct(F.avg("revenue").alias("mean"),
                                F.count(F.lit(1)).alias("months"))).scalar()
    position = F.row_number().over(Window.orderBy("month")) - 1
    step = F.greatest(F.lit(1), F.floor(stats["months"] / ticks))
    return (series.withColumn("position", position)
            .withColumn("mean_revenue", stats["mean"])
            .withColumn("is_tick", F.col("position") % step == 0)
            .withColumn("label", F.date_format("month", "yyyy-MM")))


def monthly_stats(df: DataFrame) -> DataFrame:
    """Number, mean, spread and extremes of the monthly revenues."""
    r = F.col("revenue")
    return monthly(df).where(F.col("month").isNotNull()).agg(
        F.count(F.lit(1)).alias("months"), F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std_sample"), F.stddev_pop(r).alias("std_population"),
        F.min(r).alias("min"), F.max(r).alias("max"))


def quarterly(df: DataFrame) -> DataFrame:
    out = df.groupBy("Year", "Quarter").agg(total(F.col("TotalPrice")).alias("revenue"))
    return (out.withColumn("label", year_quarter(F.col("Year"), F.col("Quarter")))
            .orderBy("Year", "Quarter"))


def year_months(df: DataFrame) -> DataFrame:
    """Revenue and last date per year and month: the base of yearly reports."""
    return (df.where(F.col("Date").isNotNull())
            .groupBy(F.year("Date").alias("Year"), F.month("Date").alias("Month"))
            .agg(total(F.col("TotalPrice")).alias("revenue"), F.max("Date").alias("last_date")))


def annual(df: DataFrame) -> DataFrame:
    """Revenue per year; a last year that stops before December is flagged."""
    base = year_months(df)
    years = base.groupBy("Year").agg(
        total(F.col("revenue")).alias("revenue"), F.max("Month").alias("last_month"))
    newest = base.agg(F.max("Year")).scalar()
    partial = (F.col("Year") == newest) & (F.col("last_month") < 12)
    label = F.when(partial, F.concat(F.col("Year").cast("string"), F.lit(" (to month "),
                                     F.col("last_month").cast("string"), F.lit(")")))
    return (years.withColumn("is_partial", partial)
            .withColumn("label", F.coalesce(label, F.col("Year").cast("string")))
            .orderBy("Year"))


def like_for_like(df: DataFrame, months: int | None = None,
                  drop_last_month: bool = False) -> DataFrame:
    """Last year against the same months of the year before.

    `months` is the number of months compared, counted from January; by
    default it follows from the last date. `drop_last_month` leaves the month
    of the last date out, for data that stops within a month. One row:
    revenue of both periods, change, the misleading change of all the last
    year's sales against the whole earlier year, and the last year scaled to
    twelve months.
    """
    rows = F.struct(F.col("last_date").alias("date"), F.col("Year").alias("year"),
                    F.col("Month").alias("month"), F.col("revenue"))
    # A row per month seen: all of them fit one array, so nothing is read twice.
    one = year_months(df).agg(F.collect_list(rows).alias("m")).withColumn(
        "edge", F.array_max(F.transform("m", lambda r: F.struct(
            r["date"].alias("date"), r["year"].alias("year"), r["month"].alias("month")))))
    seen = F.col("edge.month") - (1 if drop_last_month else 0)
    one = one.withColumn("cutoff", F.lit(months) if months is not None else seen)

    def revenue(of: Column, upto: Column | None = None) -> Column:
        """Sum over the year's months, the largest first for a fixed order; null for none."""
        kept = F.filter("m", lambda r: (r["year"] == of) & (
            F.lit(True) if upto is None else r["month"] <= upto))
        values = F.sort_array(F.transform(kept, lambda r: r["revenue"]), asc=False)
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b))

    earlier = F.array_max(F.transform(
        F.filter("m", lambda r: r["year"] < F.col("edge.year")), lambda r: r["year"]))
    year, cutoff = F.col("edge.year"), F.col("cutoff")
    part_year = ratio(revenue(year), revenue(earlier))
    return (one.select(
        revenue(year, cutoff).alias("current"), revenue(year - 1, cutoff).alias("previous"),
        revenue(earlier).alias("previous_full"), year.alias("year"),
        F.col("edge.month").alias("last_month"), F.col("edge.date").alias("last_date"),
        cutoff.alias("months_compared"), ((part_year - 1) * 100).alias("apparent_pct"))
        .withColumn("change_pct", (ratio(F.col("current"), F.col("previous")) - 1) * 100)
        .withColumn("annualised",
                    F.col("current") * ratio(F.lit(12.0), F.col("months_compared")))
        .withColumn("annualised_pct",
                    (ratio(F.col("annualised"), F.col("previous_full")) - 1) * 100))


def same_month_last_year(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each month of the filled series against the same month a year before."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("ds")
    return (monthly_filled(df, by).withColumn("previous", F.lag("y", 12).over(w))
            .withColumn("change_pct", (ratio(F.col("y"), F.col("previous")) - 1) * 100))

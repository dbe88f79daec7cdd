"""Headline numbers of the sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.derive import discount_given
from tallymark.functions.numeric import mean, ratio, total
from tallymark.operators.ordered import exact_median
from tallymark.session import materialise


def kpi_global(df: DataFrame) -> DataFrame:
    """Orders, gross, net and lost revenue, averages, return rate, shipping."""
    return (df.agg(
        F.count(F.lit(1)).alias("lines"),
        total(F.col("TotalPrice")).alias("gross_revenue"),
        total(F.col("NetRevenue")).alias("net_revenue"),
        mean(F.col("TotalPrice")).alias("avg_order_value"),
        (F.avg("Returned") * 100).alias("return_rate"),
        F.avg("DeliveryDays").alias("avg_delivery_days"),
        total(F.col("ShippingCost")).alias("shipping"))
        .withColumn("lost_revenue", F.col("gross_revenue") - F.col("net_revenue")))


def kpi_cards(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The report's cards: the headline numbers with their second lines.

    Sales are added up per day, the days into the cards; days and months are
    counted on the way. Orders per month divides by the months seen.
    `approximate` takes the median from a sketch, in one read; the exact median reads more
    often, so the few columns needed are written out first.
    """
    if not approximate:
        df = materialise(df.select("Date", "TotalPrice", "NetRevenue", "Returned", "Discount",
                                   discount_given().alias("_given")), "kpi-columns")

    def averaged_days(name: str) -> Column:
        return ratio(total(F.col(f"{name}_sum")), F.sum(f"{name}_n"))

    averaged = ["TotalPrice", "Returned", "Discount"]
    days = df.groupBy(F.to_date("Date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), total(F.col("NetRevenue")).alias("net"),
        total(F.col("_given") if "_given" in df.columns else discount_given()).alias("given"),
        *[total(F.col(c)).alias(f"{c}_sum") for c in averaged],
        *[F.count(c).alias(f"{c}_n") for c in averaged])
    median = df.agg(F.percentile_approx("TotalPrice", 0.5, 10_000)) if approximate \
        else exact_median(df, "TotalPrice")
    cards = days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        total(F.col("TotalPrice_sum")).alias("gross_revenue"),
        total(F.col("net")).alias("net_revenue"),
        averaged_days("TotalPrice").alias("avg_order_value"),
        total(F.col("Returned_sum")).cast("bigint").alias("returned"),
        (averaged_days("Returned") * 100).alias("return_rate"),
        total(F.col("given")).alias("discount_given"),
        (averaged_days("Discount") * 100).alias("avg_discount_pct"),
        F.count("day").alias("days"),
        F.countDistinct(F.trunc("day", "MM")).alias("_months"))
    return (cards.withColumn("median_order_value", median.scalar())
            .withColumn("lost_revenue", F.col("gross_revenue") - F.col("net_revenue"))
            .withColumn("orders_per_month", ratio(F.col("lines"), F.col("_months")))
            .drop("_months"))


def hero_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct regions, products, salespeople and months; nulls do not count."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count("Region").alias("regions"), count("Product").alias("products"),
                  count("Salesperson").alias("salespeople"),
                  count(F.trunc("Date", "MM")).alias("months"))

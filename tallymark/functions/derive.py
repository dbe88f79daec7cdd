"""Column expressions of the cleaned table: dates, money, buckets, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.schema import DISCOUNT_BUCKETS, NO_PROMOTION


def fill_promotion(promotion: Column) -> Column:
    return F.coalesce(promotion, F.lit(NO_PROMOTION))


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end, rounded down (-12 h is -1).

    Calendar days apart, less one if the end's time of day is the earlier one;
    no session time zone is involved.
    """
    apart = F.datediff(end, start)
    return F.when(start + F.make_dt_interval(apart) > end, apart - 1).otherwise(apart)


def list_price(sign_discount: Column) -> Column:
    return F.col("Quantity") * F.col("UnitPrice") * sign_discount


def recomputed_revenue() -> Column:
    return list_price(1 - F.col("Discount"))


def discount_given() -> Column:
    return list_price(F.col("Discount"))


def net_revenue() -> Column:
    """A returned order earns nothing."""
    return F.col("TotalPrice") * (1 - F.col("Returned"))


def discount_bucket(rate: Column) -> Column:
    """Upper bounds are inclusive; a null or NaN rate lands in the last bucket."""
    none, low, mid, high = DISCOUNT_BUCKETS
    return (F.when(rate == 0, none).when(rate <= 0.05, low).when(rate <= 0.10, mid)
            .otherwise(high))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def half_year(month: Column) -> Column:
    return F.when(month <= 6, "H1").otherwise("H2")


def year_quarter(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))


# Each derived column: the columns it needs, and its expression.
DERIVED: dict[str, tuple[list[str], object]] = {
    "DeliveryDays": (["OrderDate", "DeliveryDate"],
                     lambda: whole_days(F.col("OrderDate"), F.col("DeliveryDate"))),
    "CalcRevenue": (["Quantity", "UnitPrice", "Discount"], recomputed_revenue),
    "Year": (["Date"], lambda: F.year("Date")),
    "Month": (["Date"], lambda: F.month("Date")),
    "Quarter": (["Date"], lambda: F.quarter("Date")),
    "YearMonth": (["Date"], lambda: year_month(F.col("Date"))),
    "NetRevenue": (["TotalPrice", "Returned"], net_revenue),
    "GrossProfit": (["TotalPrice", "Returned", "ShippingCost"],
                    lambda: net_revenue() - F.col("ShippingCost")),
    "DiscountBucket": (["Discount"], lambda: discount_bucket(F.col("Discount"))),
}


# Display labels: never group or join on these.

def currency(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 0))


def percent(value: Column, signed: bool = False) -> Column:
    return F.format_string("%+.1f%%" if signed else "%.1f%%", value)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")

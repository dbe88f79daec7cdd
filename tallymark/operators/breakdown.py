"""Group-by reports: measures per level, shares, distance from the overall rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.numeric import mean, ratio, total
from tallymark.schema import DISCOUNT_BUCKETS, NO_PROMOTION

MEASURES: dict[str, object] = {
    "orders": lambda: F.count("OrderID"),
    "lines": lambda: F.count(F.lit(1)),
    "distinct_orders": lambda: F.countDistinct("OrderID"),
    "gross_revenue": lambda: total(F.col("TotalPrice")),
    "net_revenue": lambda: total(F.col("NetRevenue")),
    "avg_order_value": lambda: mean(F.col("TotalPrice")),
    "returned": lambda: F.coalesce(F.sum("Returned"), F.lit(0)),
    "return_rate": lambda: F.avg("Returned"),
    "avg_unit_price": lambda: F.avg("UnitPrice"),
    "avg_quantity": lambda: F.avg("Quantity"),
    "avg_discount": lambda: F.avg("Discount"),
    "undiscounted": lambda: F.count_if(F.col("Discount") == 0),
    "avg_delivery_days": lambda: F.avg("DeliveryDays"),
    "avg_shipping": lambda: F.avg("ShippingCost"),
}
PERCENTAGES = {"return_rate", "avg_discount"}
COUNTS = {"orders", "lines", "distinct_orders", "returned", "undiscounted"}


def rounded(name: str, digits: int = 2, twice: bool = False) -> Column:
    """Report rounding, half-even: percentages to one digit, money to two."""
    if name in PERCENTAGES:
        rate = F.bround(F.col(name), 2) if twice else F.col(name)
        return F.bround(rate * 100, 1).alias(name)
    return (F.col(name) if name in COUNTS else F.bround(F.col(name), digits)).alias(name)


def ordered(df: DataFrame, keys: list[str], by: str | None, descending: bool = True) -> DataFrame:
    """Sort by a measure, nulls last, the keys breaking ties."""
    ties = [F.col(k).asc_nulls_last() for k in keys]
    if by is None:
        return df.orderBy(*ties)
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *ties)


def breakdown(df: DataFrame, keys: list[str], measures: list[str], order_by: str | None = None,
              descending: bool = True, drop_null_keys: bool = False, digits: int = 2,
              round_twice: bool = False) -> DataFrame:
    """One row per combination of `keys` with rounded `measures`.

    A null key is kept as a group of its own unless `drop_null_keys`.
    `round_twice` rounds rates before they become percentages.
    """
    if drop_null_keys:
        df = df.dropna(subset=keys)
    out = df.groupBy(*keys).agg(*[MEASURES[m]().alias(m) for m in measures])
    out = out.select(*keys, *[rounded(m, digits, round_twice) for m in measures])
    return ordered(out, keys, order_by, descending)


def share_of_total(df: DataFrame, keys: list[str], value: str = "TotalPrice") -> DataFrame:
    """Revenue, share of the total in percent and rows per level."""
    groups = df.groupBy(*keys).agg(total(F.col(value)).alias("revenue"),
                                   F.count(F.lit(1)).alias("lines"))
    whole = groups.agg(total(F.col("revenue"))).scalar()
    return groups.withColumn("share_pct", ratio(F.col("revenue"), whole) * 100)


def rate_vs_overall(df: DataFrame, key: str) -> DataFrame:
    """Return rate per level beside the overall rate; difference in points."""
    groups = df.groupBy(key).agg(F.count("Returned").alias("lines"),
                                 F.coalesce(F.sum("Returned"), F.lit(0)).alias("returned"))
    overall = groups.agg(ratio(F.sum("returned"), F.sum("lines")) * 100).scalar()
    return (groups.withColumn("rate", ratio(F.col("returned"), F.col("lines")) * 100)
            .withColumn("overall", overall)
            .withColumn("difference", F.col("rate") - F.col("overall"))
            .withColumn("at_or_below", F.col("rate") <= F.col("overall")))


def level_totals(df: DataFrame, dims: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Every single-dimension breakdown in one pass over the sales.

    Long form: `dim`, `level`, `lines`, `revenue`, `rated` (rows with a return
    flag), `returned`. A null key gives a null level.
    """
    measures = {
        "lines": F.count(F.lit(1)),
        "revenue": total(F.col("TotalPrice")),
        "rated": F.count("Returned"),
        "returned": F.coalesce(F.sum("Returned"), F.lit(0)),
        **(extra or {}),
    }
    grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *[e.alias(n) for n, e in measures.items()],
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, d) for d in dims])
    level = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return grouped.select(dim.alias("dim"), level.alias("level"), *measures)


def promotion_measures() -> dict[str, Column]:
    """Sums that `undiscounted_from_levels` needs beside the totals per level."""
    return {"discounts": F.count("Discount"), "discount_sum": F.sum("Discount"),
            "undiscounted": F.count_if(F.col("Discount") == 0)}


def undiscounted_from_levels(levels: DataFrame) -> DataFrame:
    """`undiscounted_promotions` from totals per level with `promotion_measures`."""
    coded = levels.where((F.col("dim") == "Promotion") & (F.col("level") != NO_PROMOTION))
    out = coded.rollup("level").agg(
        F.sum("lines").alias("lines"),
        ratio(F.sum("discount_sum"), F.sum("discounts")).alias("avg_discount"),
        F.sum("undiscounted").alias("undiscounted"), F.grouping("level").alias("is_total"))
    return promotion_rows(out.withColumnRenamed("level", "Promotion"))


def group_spread(df: DataFrame, dims: list[str]) -> DataFrame:
    """How far apart the levels of each dimension lie.

    Group sizes, revenue gap between the best and the worst level (amount,
    share points, percent of the worst), and the levels with the highest and
    lowest return rate; ties go to the level that sorts first.
    """
    rate = F.col("returned") / F.nullif(F.col("rated").cast("double"), F.lit(0.0)) * 100
    levels = (level_totals(df, dims).where(F.col("level").isNotNull())
              .withColumn("rate", rate))
    gap = F.max("revenue") - F.min("revenue")
    out = levels.groupBy("dim").agg(
        F.count(F.lit(1)).alias("levels"),
        F.min("lines").alias("min_lines"),
        F.max("lines").alias("max_lines"),
        F.floor(F.avg("lines")).alias("mean_lines"),
        F.min("revenue").alias("min_revenue"),
        F.max("revenue").alias("max_revenue"),
        gap.alias("revenue_gap"),
        (ratio(gap, total(F.col("revenue"))) * 100).alias("gap_points"),
        (ratio(gap, F.min("revenue")) * 100).alias("gap_pct"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        (F.max("rate") - F.min("rate")).alias("rate_spread"),
        F.min(F.when(F.col("rate").isNotNull(), F.struct(-F.col("rate"), F.col("level"))))
        .alias("_hi"),
        F.min(F.when(F.col("rate").isNotNull(), F.struct(F.col("rate"), F.col("level"))))
        .alias("_lo"))
    return (out.withColumn("highest_rate_level", F.col("_hi")["level"])
            .withColumn("lowest_rate_level", F.col("_lo")["level"]).drop("_hi", "_lo"))


def delivery_stats(df: DataFrame, key: str = "Region", value: str = "DeliveryDays") -> DataFrame:
    """Mean, median, minimum and maximum of a whole-number column per level.

    The sales are read once, into a count per level and value. The median lies between the
    values at which the running count passes half of the level's rows; the window runs over a
    level's values, of which a number of days has few.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    level = Window.partitionBy(key)
    upto = level.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = (F.sum("_n").over(level) - 1) / 2
    placed = (counts.withColumn("_end", F.sum("_n").over(upto)).withColumn("_half", half)
              .withColumn("_start", F.col("_end") - F.col("_n")))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col(value)))

    return placed.groupBy(key).agg(
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        ((at(F.floor("_half")) + at(F.ceil("_half"))) / 2).alias("median"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def discount_tiers(df: DataFrame) -> DataFrame:
    """Average order value per discount bucket, every bucket listed in order."""
    return listed_tiers(df.groupBy(F.col("DiscountBucket").alias("bucket")).agg(
        mean(F.col("TotalPrice")).alias("avg_order_value"), F.count(F.lit(1)).alias("lines")))


def listed_tiers(found: DataFrame) -> DataFrame:
    """Line a table keyed by `bucket` up with the fixed list of buckets."""
    tiers = found.sparkSession.createDataFrame(
        [(i, b) for i, b in enumerate(DISCOUNT_BUCKETS)], "position int, bucket string")
    return tiers.join(found, "bucket", "left").orderBy("position")


def undiscounted_promotions(df: DataFrame) -> DataFrame:
    """Per promotion code: orders, average discount, orders without any discount.

    A last row named `(all)` adds the codes up. Orders without a code are left
    out.
    """
    coded = df.where(F.col("Promotion") != NO_PROMOTION)
    out = coded.rollup("Promotion").agg(
        F.count(F.lit(1)).alias("lines"),
        F.avg("Discount").alias("avg_discount"),
        F.count_if(F.col("Discount") == 0).alias("undiscounted"),
        F.grouping("Promotion").alias("is_total"))
    return promotion_rows(out)


def promotion_rows(out: DataFrame) -> DataFrame:
    return (out.withColumn("promotion", F.when(F.col("is_total") == 1, "(all)")
                           .otherwise(F.col("Promotion")))
            .withColumn("undiscounted_pct",
                        ratio(F.col("undiscounted"), F.col("lines")) * 100)
            .orderBy("is_total", "promotion")
            .select("promotion", "lines", (F.col("avg_discount") * 100).alias("avg_discount_pct"),
                    "undiscounted", "undiscounted_pct"))

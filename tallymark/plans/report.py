"""The tables behind every chart, and the report written as Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.derive import currency, month_label, percent
from tallymark.functions.numeric import ratio, total
from tallymark.operators import checks
from tallymark.operators.breakdown import (level_totals, listed_tiers, ordered,
                                           promotion_measures)
from tallymark.operators.periods import annual, monthly_trend, quarterly
from tallymark.operators.stats import chi_square, correlations, trend_forecast
from tallymark.plans.kpi import hero_counts, kpi_cards
from tallymark.plans.notes import days_of, notes_from
from tallymark.schema import CORRELATED
from tallymark.session import materialise
from tallymark.sources import versions

CHART_DIMS = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion", "Salesperson"]

# Bar and pie charts: the dimension, the sort column, and whether it descends.
LEVEL_CHARTS = {
    "c-region": ("Region", "revenue", False),
    "c-product": ("Product", "revenue", False),
    "c-returns": ("Product", "return_rate", False),
    "c-payment": ("PaymentMethod", "revenue", True),
    "c-promo": ("Promotion", "revenue", True),
    "c-delivery": ("Region", "avg_delivery_days", False),
    "c-sales": ("Salesperson", "revenue", False),
    "returns-by-region": ("Region", "return_rate", False),
    "returns-by-salesperson": ("Salesperson", "return_rate", False),
    "revenue-by-salesperson": ("Salesperson", "revenue", True),
}


def chart_levels(df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Everything the bar charts show, for all dimensions, from one pass.

    Averages are kept as sums and counts until the end, so the overall rate
    and the shares come from the same small table.
    """
    dims = dims or CHART_DIMS
    return levels_shown(level_totals(df, dims, level_measures()), dims)


def level_measures() -> dict:
    return {"avg_discount": F.avg("Discount"), "avg_delivery_days": F.avg("DeliveryDays"),
            **promotion_measures()}


def levels_shown(base: DataFrame, dims: list[str]) -> DataFrame:
    """What the charts show of totals per level with `level_measures`."""
    whole = (base.where(F.col("dim") == dims[0])
             .agg(F.struct(total(F.col("revenue")).alias("revenue"), F.sum("rated").alias("rated"),
                           F.sum("returned").alias("returned"))).scalar())
    overall = ratio(whole["returned"], whole["rated"]) * 100
    return (base.select(
        "dim", "level", "lines", "revenue", (F.col("revenue") / 1000).alias("revenue_k"),
        (ratio(F.col("revenue"), whole["revenue"]) * 100).alias("share_pct"),
        (F.col("revenue") / F.col("lines")).alias("avg_order_value"),
        "rated", "returned",
        (ratio(F.col("returned"), F.col("rated")) * 100).alias("return_rate"),
        overall.alias("overall_rate"),
        (F.col("avg_discount") * 100).alias("avg_discount_pct"), "avg_delivery_days")
        .withColumn("at_or_below", F.col("return_rate") <= F.col("overall_rate")))


def daily(df: DataFrame) -> DataFrame:
    """Revenue per day: a small stand-in for the sales in every period report."""
    return days_of(df).withColumns({"Year": F.year("Date"), "Quarter": F.quarter("Date")})


def grids(df: DataFrame) -> DataFrame:
    """Both two-way tables from one pass, long form with the grid's name."""
    cols = [F.col(c) for c in ("Region", "Product", "CustomerType")]
    both = df.groupingSets([[cols[0], cols[1]], [cols[1], cols[2]]], *cols).agg(
        total(F.col("TotalPrice")).alias("revenue"), F.count(F.lit(1)).alias("lines"),
        (F.avg("Returned") * 100).alias("return_rate"), F.grouping("Region").alias("_g"))
    first = F.col("_g") == 0
    return both.select(
        F.when(first, "Region x Product").otherwise("Product x CustomerType").alias("grid"),
        F.when(first, F.col("Region")).otherwise(F.col("Product")).alias("row"),
        F.when(first, F.col("Product")).otherwise(F.col("CustomerType")).alias("column"),
        "revenue", (F.col("revenue") / 1000).alias("revenue_k"), "lines", "return_rate")


def charts(df: DataFrame, base: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """Name of each chart and its table, from the sales and their written totals."""
    levels = materialise(levels_shown(base, CHART_DIMS), "levels")
    pairs = materialise(grids(df), "grids")
    tests = chi_square(levels.where(F.col("dim").isin(CHART_DIMS))).select("dim", "p_value", "verdict")
    out = {}
    for name, (dim, sort, descending) in LEVEL_CHARTS.items():
        rows = (levels.where(F.col("dim") == dim).join(F.broadcast(tests), "dim", "left")
                .withColumns({"revenue_label": currency(F.col("revenue")),
                              "rate_label": percent(F.col("return_rate"))}))
        out[name] = ordered(rows, ["level"], sort, descending)
    out["c-trend"] = monthly_trend(days).withColumn(
        "month_name", month_label(F.col("month"))).orderBy("month")
    out["c-year"] = annual(days)
    out["revenue-by-quarter"] = quarterly(days)
    heat = pairs.where(F.col("grid") == "Region x Product")
    out["c-heat"] = heat.orderBy("row", "column")
    out["product-by-customer-type"] = pairs.where(
        F.col("grid") == "Product x CustomerType").orderBy("row", "column")
    out["discount-tiers"] = listed_tiers(levels.where(F.col("dim") == "DiscountBucket").select(
        F.col("level").alias("bucket"), "avg_order_value", "lines"))
    out["correlation"] = correlations(df, CORRELATED).where("lower")
    out["forecast"] = trend_forecast(days).orderBy("step")
    return out


def report_tables(cleaned: DataFrame, unfilled: DataFrame, key: str = "OrderID",
                  months: int | None = None, stored: bool = False) -> dict[str, DataFrame]:
    """Name of each table of the report, and the table.

    `unfilled` is the sales table before null promotions are filled, so the checks see them.
    Both are read once: what the report needs of them is written out, and so are the totals per
    level and day that most tables rest on. With `stored` the two are files read and projected, and
    are not written again.
    """
    if not stored:
        cleaned = materialise(cleaned, "report-sales", "zstd")
        unfilled = materialise(unfilled, "report-unfilled", "zstd")
    base = materialise(level_totals(cleaned, [*CHART_DIMS, "DiscountBucket"], level_measures()),
                       "level-totals")
    days = materialise(daily(cleaned), "days")
    tables = {f"chart={name}": table for name, table in charts(cleaned, base, days).items()}
    found = materialise(checks.all_checks(unfilled, key), "checks")
    return tables | {
        "checks": found, "checks_tally": checks.tally(found), "kpis": kpi_cards(cleaned),
        "hero": hero_counts(cleaned), "notes": notes_from(base, days, months)}


ROW = "table string, position long, cells map<string,string>"


def write_report(cleaned: DataFrame, unfilled: DataFrame, path: str, key: str = "OrderID",
                 months: int | None = None, stored: bool = False) -> list[str]:
    """Publish charts, checks, KPIs and notes below `path`; returns the names of the tables.

    All tables go through one partitioned write into a folder of their own, which then becomes
    the current version. A reader finds the old report or the whole new one.
    """
    tables = report_tables(cleaned, unfilled, key, months, stored)
    return publish_tables(tables, path, cleaned.sparkSession)


def publish_tables(tables: dict[str, DataFrame], path: str, spark: SparkSession) -> list[str]:
    """Write small tables of any columns as one version; `position` keeps their rows' order."""
    def rows(name: str, table: DataFrame) -> DataFrame:
        cells = F.map_from_arrays(
            F.array(*[F.lit(c) for c in table.columns]),
            F.array(*[F.col(f"`{c}`").cast("string") for c in table.columns]))
        return table.select(F.lit(name).alias("table"), F.monotonically_increasing_id().alias("position"),
                            cells.alias("cells"))

    def write(folder: str) -> dict:
        whole = reduce(DataFrame.unionByName, [rows(n, t) for n, t in tables.items()])
        whole.write.partitionBy("table").parquet(folder)
        return {"tables": {n: [[c, t] for c, t in table.dtypes] for n, table in tables.items()}}

    versions.publish(spark, path, write)
    return sorted(tables)


def read_report(spark: SparkSession, path: str, in_order: bool = True) -> dict[str, DataFrame]:
    """The tables of the current version, with their columns and types, and their order of rows
    unless `in_order` is false."""
    about = versions.current(spark, path)
    stored = spark.read.schema(ROW).parquet(f"{path}/{about['version']}")

    def rows(name: str) -> DataFrame:
        own = stored.where(F.col("table") == name)
        return own.orderBy("position") if in_order else own

    return {name: rows(name).select(*[F.col("cells")[c].cast(t).alias(c) for c, t in columns])
            for name, columns in about["tables"].items()}


def long_form(table: DataFrame, name: str) -> DataFrame:
    """Every cell of a table as text: table, row (its text columns), column, value."""
    table = table.select(*[F.col(c).cast("double") if t.startswith("decimal") else F.col(c)
                           for c, t in table.dtypes])
    text = [c for c, t in table.dtypes if t == "string"]
    row = F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("-")) for c in text])

    def shown(column: str, kind: str):
        value = F.col(column).cast("string")
        if kind == "double":  # 0.0 is added so that there is no negative zero
            value = F.when(F.col(column).isNotNull(),
                           F.format_string("%.2f", F.round(F.col(column), 2) + F.lit(0.0)))
        return F.struct(F.lit(column).alias("column"), value.alias("value"))

    cells = F.explode(F.array(*[shown(c, t) for c, t in table.dtypes if t != "string"] or
                              [F.struct(F.lit("").alias("column"),
                                        F.lit(None).cast("string").alias("value"))]))
    return table.select(F.lit(name).alias("table"), row.alias("row"), cells.alias("c")).select(
        "table", "row", "c.*")

"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from tallymark.functions.derive import discount_given, half_year, year_quarter  # noqa: E402
from tallymark.functions.derive import fill_promotion  # noqa: E402
from tallymark.operators import breakdown as bd  # noqa: E402
from tallymark.operators import checks, clean, crosstab, multiset, ordered  # noqa: E402
from tallymark.operators import periods, profile, sketches  # noqa: E402
from tallymark.operators import scores, stats  # noqa: E402
from tallymark.plans import kpi, models, notes, report, saved  # noqa: E402
from tallymark.schema import (CATEGORIES, CLEAN_COLUMNS, CORRELATED, NULL_TOKENS,  # noqa: E402
                              PROFILED, RECONCILED, raw_schema)
from tallymark.session import input_bytes, materialise, new_path, tune  # noqa: E402
from tallymark.sources import files  # noqa: E402
from tallymark.sources.star import UNSPECIFIED_PRIORITY, raw_sales, sales  # noqa: E402

try:
    import corpus_pipeline
    from tallymark.llm import queries as llm_queries
except ImportError:  # both go together, also if a library they need is missing
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
# Trees, rounds and folds are the library's: 100, 100 and 5. Forests grow until leaves are pure.
TREES, FOLDS = 100, 5
FACT = ["lineitem", "orders"]  # what grows among the tables of the sales
TEXTS = ["documents", "pages"]
# Columns of the wide tables that are registered.
PRODUCTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CUSTOMER_TYPES = ["F", "O"]

Query = Callable[[SparkSession, str], DataFrame]


def fixed(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles, so the last bits of a sum do not depend on its order.

    Prices have four decimals, so sums per group are rounded to four (never
    half-way between two results) and sums over all sales to one.
    """
    return df.select(*[
        F.round(F.col(f"`{n}`"), special.get(n, digits)).alias(n) if t == "double"
        else F.col(f"`{n}`") for n, t in df.dtypes])


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# -- sources and cleaning ---------------------------------------------------

def null_normalize_fill(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderpriority").alias("Promotion"))
    nulled = clean.normalise_nulls(orders, ["Promotion"], [*NULL_TOKENS, UNSPECIFIED_PRIORITY])
    return nulled.groupBy(fill_promotion(F.col("Promotion")).alias("promotion")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("Promotion").isNull()).alias("filled"))


def roundtrip(fmt: str) -> Query:
    def run(spark, d):
        source = sales(spark, d)
        path = new_path(spark, f"cleaned-{fmt}")
        files.write_clean(source, path, fmt)
        read = files.read_clean_csv if fmt == "csv" else files.read_clean_parquet
        return fixed(checks.compare_copies(
            source, read(spark, path), ["Region", "Product", "CustomerType", "Promotion"]), 1)
    return run


def derive_features(spark, d):
    df = clean.add_derived(raw_sales(spark, d).withColumn(
        "Promotion", fill_promotion(F.col("Promotion"))))
    out = df.select(
        F.col("OrderID").alias("order_id"), F.col("Promotion").alias("promotion"),
        F.col("DeliveryDays").alias("delivery_days"), F.col("UnitPrice").alias("unit_price"),
        F.col("CalcRevenue").alias("calc_revenue"), F.col("Year").alias("year"),
        F.col("Month").alias("month"), F.col("Quarter").alias("quarter"),
        F.col("YearMonth").alias("year_month"), F.col("NetRevenue").alias("net_revenue"),
        F.col("GrossProfit").alias("gross_profit"), F.col("DiscountBucket").alias("bucket"),
        half_year(F.col("Month")).alias("half"),
        year_quarter(F.col("Year"), F.col("Quarter")).alias("year_quarter"),
        discount_given().alias("discount_given"))
    return fixed(out, 8, calc_revenue=4, net_revenue=4, gross_profit=4, discount_given=4)


def dedupe_rows(spark, d):
    some = clean.drop_duplicate_rows(sales(spark, d, "Date", "Region", "Product", "Promotion"))
    whole = clean.drop_duplicate_rows(raw_sales(spark, d)).groupBy(
        "Date", "Region", "Product", fill_promotion(F.col("Promotion")).alias("Promotion")).agg(
        F.count(F.lit(1)).alias("whole_rows"))
    keys = ["Date", "Region", "Product", "Promotion"]
    same = [some[k].eqNullSafe(whole[k]) for k in keys]
    return some.join(whole, same, "left").select(
        F.date_format(some["Date"], "yyyy-MM-dd HH:mm:ss").alias("Date"),
        *[some[k] for k in keys[1:]], "whole_rows")


def cleaning_path(spark, d):
    """Raw CSV with doubled rows and null tokens, written from the tables, then cleaned."""
    raw = raw_sales(spark, d)
    raw = raw.select(*[F.col(f.name).cast(f.dataType) for f in raw_schema().fields])
    doubled = raw.unionByName(raw.where(F.col("OrderID").cast("bigint") % 7 == 0))
    text = doubled.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c)
                            for c in doubled.columns])
    path = new_path(spark, "raw-csv")
    files.write_csv(text, path)
    cleaned = clean.clean(files.read_raw_csv(spark, path))
    stored = new_path(spark, "raw-parquet")
    files.read_raw_csv(spark, path).write.option("compression", "zstd").parquet(stored)
    again = clean.clean(files.read_raw_parquet(spark, stored))
    return reduce(DataFrame.unionByName, [
        fixed(cleaned_rows(df).withColumn("source", F.lit(name)), 4)
        for name, df in (("csv", cleaned), ("parquet", again))])


def cleaned_rows(df: DataFrame) -> DataFrame:
    return df.groupBy("YearMonth", "Promotion", "DiscountBucket").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Returned").alias("returned"),
        F.sum("DeliveryDays").alias("delivery_days"), F.sum("Quarter").alias("quarters"),
        F.sum("CalcRevenue").alias("calc_revenue"), F.sum("NetRevenue").alias("net_revenue"),
        F.sum("GrossProfit").alias("gross_profit"),
        F.date_format(F.min("OrderDate"), "yyyy-MM-dd").alias("first_order"),
        F.date_format(F.max("DeliveryDate"), "yyyy-MM-dd").alias("last_delivery"))


def duplicate_rows(spark, d):
    whole = clean.duplicate_rows(raw_sales(spark, d)).withColumn("table", F.lit("sales"))
    some = clean.duplicate_rows(sales(spark, d, "Date", "Region", "Product"))
    return whole.unionByName(some.withColumn("table", F.lit("date, region, product")))


def key_uniqueness(spark, d):
    lines = clean.key_uniqueness(sales(spark, d, "OrderID"), "OrderID")
    orders = clean.key_uniqueness(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey")
    return lines.withColumn("table", F.lit("sales")).unionByName(
        orders.withColumn("table", F.lit("orders")))


# -- reports ----------------------------------------------------------------

REPORTS: dict[str, tuple[str, list[str], str | None, bool]] = {
    # name: key, measures, sorted by, rates rounded twice
    "by_region": ("Region", ["orders", "gross_revenue", "net_revenue", "avg_order_value",
                             "return_rate"], "gross_revenue", False),
    "by_product": ("Product", ["orders", "gross_revenue", "avg_unit_price", "avg_quantity",
                               "return_rate"], "gross_revenue", False),
    "by_customer_type": ("CustomerType", ["orders", "gross_revenue", "avg_order_value",
                                          "return_rate"], None, True),
    "by_promotion": ("Promotion", ["orders", "gross_revenue", "avg_order_value",
                                   "avg_discount"], "gross_revenue", True),
    "by_payment": ("PaymentMethod", ["orders", "gross_revenue", "avg_order_value"],
                   "gross_revenue", False),
    "by_salesperson": ("Salesperson", ["orders", "gross_revenue", "avg_order_value",
                                       "return_rate", "avg_delivery_days"],
                       "gross_revenue", True),
    "by_manager": ("RegionManager", ["orders", "gross_revenue", "return_rate", "avg_shipping"],
                   "gross_revenue", True),
    "by_region_order_grain": ("Region", ["lines", "distinct_orders", "gross_revenue",
                                         "undiscounted", "returned"], "gross_revenue", False),
    "by_salesperson_rounded_once": ("Salesperson", ["orders", "return_rate"], None, False),
}
NEEDS = {"orders": "OrderID", "distinct_orders": "OrderID", "gross_revenue": "TotalPrice",
         "net_revenue": "NetRevenue", "avg_order_value": "TotalPrice", "return_rate": "Returned",
         "returned": "Returned", "avg_unit_price": "UnitPrice", "avg_quantity": "Quantity",
         "avg_discount": "Discount", "undiscounted": "Discount",
         "avg_delivery_days": "DeliveryDays", "avg_shipping": "ShippingCost"}


def report_by(name: str) -> Query:
    key, measures, order, twice = REPORTS[name]
    inputs = sorted({NEEDS[m] for m in measures if m in NEEDS})
    return lambda spark, d: bd.breakdown(
        sales(spark, d, key, *inputs), [key], measures, order, digits=4, round_twice=twice)


def by_promotion_without_null(spark, d):
    df = raw_sales(spark, d, "Promotion", "OrderID", "TotalPrice")
    return bd.breakdown(df, ["Promotion"], ["orders", "gross_revenue"],
                        drop_null_keys=True, digits=4)


def delivery_stats(spark, d):
    return bd.delivery_stats(sales(spark, d, "Region", "DeliveryDays")).select(
        "Region", F.bround("mean", 1).alias("mean"), F.bround("median", 1).alias("median"),
        "min", "max").orderBy("Region")


def rank_salespeople(spark, d):
    revenue = bd.breakdown(sales(spark, d, "Salesperson", "TotalPrice"), ["Salesperson"],
                           ["gross_revenue"], digits=4)
    return ordered.rank_rows(revenue, "gross_revenue")


def month_column(df: DataFrame, name: str = "month") -> DataFrame:
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd"))


def dated(spark, d, *more):
    return sales(spark, d, "Date", "TotalPrice", *more)


def sketched_medians(spark, d):
    """Per region and year, from daily sketches: rows, revenue, and whether the median's rank and
    the number of orders lie within the sketches' bounds of the exact ones."""
    df = sales(spark, d, "Date", "Year", "Region", "TotalPrice", "OrderID")
    kept = materialise(sketches.daily_sketches(df, ["Region", "Year"]), "sketches")
    found = materialise(sketches.sketched(sketches.merged(kept, ["Region", "Year"]), [0.5]), "sketched")
    keys = ["Region", "Year"]
    median = F.col("quantiles")[0]
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    exact = df.join(found.withColumnsRenamed({k: f"_{k}" for k in keys}), same).groupBy(*keys).agg(
        F.max("lines").alias("lines"), F.max("revenue").alias("revenue"),
        F.avg((F.col("TotalPrice") < median).cast("double")).alias("below"),
        F.avg((F.col("TotalPrice") <= median).cast("double")).alias("upto"),
        F.countDistinct("OrderID").alias("orders"), F.max("distinct_keys").alias("estimate"))
    off = F.greatest(F.col("below") - 0.5, 0.5 - F.col("upto"), F.lit(0.0))
    return fixed(exact.select(
        *keys, "lines", "revenue", (off <= sketches.rank_error()).alias("median_within"),
        (F.abs(F.col("estimate") - F.col("orders")) <= sketches.count_error() * F.col("orders"))
        .alias("orders_within")), 4)


# -- models -----------------------------------------------------------------

def scored(spark, d, score: str):
    return sales(spark, d, score, "Returned", "CustomerType").select(
        F.col(score).alias("score"), F.col("Returned").alias("label"), "CustomerType")


def guessed(spark, d):
    return sales(spark, d, "Discount", "Returned").select(
        F.col("Returned").alias("label"),
        (F.col("Discount") >= 0.08).cast("int").alias("prediction"))


def list_price_guess(spark, d):
    return sales(spark, d, "Region", "TotalPrice", "Quantity", "UnitPrice").select(
        "Region", F.col("TotalPrice").alias("label"),
        (F.col("Quantity") * F.col("UnitPrice")).alias("prediction"))


def prepared(spark, d) -> models.Prepared:
    """Split and encoded rows of the return models; the order's number decides the split."""
    rows = sales(spark, d, "OrderID", "Returned", *models.CATEGORICAL, *models.RETURN_NUMBERS)
    return models.Prepared(rows.withColumn("label", F.col("Returned").cast("double")),
                           models.RETURN_NUMBERS, 5, 5, F.col("OrderID"), stratify=True)


def model_split(spark, d):
    return prepared(spark, d).sizes()


def category_codes(spark, d):
    return prepared(spark, d).features.codes.select(
        "column", "level", F.col("code").cast("int").alias("code"))


def scaler_stats(spark, d):
    features = prepared(spark, d).features
    scale = features.scaler()
    return spark.createDataFrame(
        [(n, float(m), float(s)) for n, m, s in zip(features.names, scale.mean, scale.std)],
        "metric string, mean double, std double")


def fixed_cards(cards: DataFrame) -> DataFrame:
    return fixed(cards, 1, median_order_value=6, avg_order_value=4, return_rate=4,
                 avg_discount_pct=6, orders_per_month=4)


def report_tables(spark, d):
    """The cells of the published report, read back from its current version. `REPORT_COLUMNS`
    names the columns of each table; a table without an entry there is an error."""
    path = new_path(spark, "report")
    raw = materialise(raw_sales(spark, d), "report-raw", "zstd")  # joined once for both sides
    filled = raw.withColumn("Promotion", fill_promotion(F.col("Promotion")))
    report.write_report(clean.add_derived(filled).select(*CLEAN_COLUMNS), clean.add_derived(raw), path,
                        stored=True)
    tables = report.read_report(spark, path, in_order=False)
    tables["kpis"] = fixed_cards(tables["kpis"])
    return reduce(DataFrame.unionByName, [
        report.long_form(table.select(*[c for c in table.columns if c in REPORT_COLUMNS[name]]), name)
        for name, table in tables.items()])


def quarantine(spark, d):
    """Raw CSV with planted values that don't parse; accepted rows, and rejected ones by reason."""
    raw = raw_sales(spark, d)
    text = raw.select(*[F.col(f.name).cast(f.dataType).cast("string").alias(f.name)
                        for f in raw_schema().fields])
    number = F.col("OrderID").cast("bigint")
    for column, divisor, value in PLANTED:
        text = text.withColumn(column, F.when(number % divisor == 0, value).otherwise(F.col(column)))
    path, sides = new_path(spark, "raw-csv"), new_path(spark, "judged")
    files.write_csv(text, path)
    files.write_judged(files.read_text_csv(spark, path), sides)
    accepted, rejected = files.read_accepted(spark, sides), files.read_rejected(spark, sides)
    none = F.lit(None).cast("string")
    listed = rejected.select(F.explode("problems").alias("p")).select("p.*")
    return reduce(DataFrame.unionByName, [
        accepted.agg(F.lit("accepted").alias("side"), none.alias("column"), none.alias("value"),
                     none.alias("reason"), F.count(F.lit(1)).alias("lines"),
                     F.sum("Quantity").cast("bigint").alias("quantity"),
                     F.sum("Returned").alias("returned")),
        rejected.agg(F.lit("rejected").alias("side"), none.alias("column"), none.alias("value"),
                     none.alias("reason"), F.count(F.lit(1)).alias("lines"),
                     F.lit(None).cast("bigint").alias("quantity"),
                     F.lit(None).cast("bigint").alias("returned")),
        listed.groupBy("column", "value", "reason").agg(F.count(F.lit(1)).alias("lines")).select(
            F.lit("problem").alias("side"), "column", "value", "reason", "lines",
            F.lit(None).cast("bigint").alias("quantity"), F.lit(None).cast("bigint").alias("returned"))])


# Fixed values of the quarantine query: the column, which orders, and what stands there.
PLANTED = [("OrderDate", 11, "2024-13-45"), ("Returned", 13, "2"), ("Quantity", 17, "ten")]


def copy_differences(spark, d):
    """Cells in which a written copy with planted changes differs from the sales, by order."""
    names = ["OrderID", "Year", "Region", "Product", "Quantity", "UnitPrice", "CustomerType"]
    source = sales(spark, d, *names)
    path = new_path(spark, "copy")
    number = F.col("OrderID").cast("bigint")
    source.withColumns({
        "Quantity": F.when(number % 101 == 0, F.col("Quantity") + 1).otherwise(F.col("Quantity")),
        "Region": F.when(number % 103 == 0, F.lit(None)).otherwise(F.col("Region"))}).write.parquet(path)
    return multiset.differences(source, spark.read.parquet(path))


LEVEL_COLUMNS = ["level", "lines", "revenue", "share_pct", "avg_order_value", "rated", "returned",
                 "return_rate", "overall_rate", "avg_discount_pct", "avg_delivery_days"]
REPORT_COLUMNS = {
    **{f"chart={name}": LEVEL_COLUMNS for name in report.LEVEL_CHARTS},
    "chart=c-trend": ["label", "month_name", "revenue", "mean_revenue", "position"],
    "chart=c-year": ["label", "revenue"], "chart=revenue-by-quarter": ["label", "revenue"],
    "chart=c-heat": ["row", "column", "revenue", "lines", "return_rate"],
    "chart=product-by-customer-type": ["row", "column", "revenue", "lines", "return_rate"],
    "chart=discount-tiers": ["bucket", "avg_order_value", "lines"],
    "chart=correlation": ["x", "y", "corr"], "chart=forecast": ["step", "x", "yhat", "band", "low", "high"],
    "checks": ["check", "label", "status", "observed", "threshold", "detail"], "checks_tally": ["overall", "passed", "warned", "failed"],
    "kpis": ["lines", "gross_revenue", "net_revenue", "avg_order_value", "returned", "return_rate",
             "discount_given", "avg_discount_pct", "days", "median_order_value", "lost_revenue",
             "orders_per_month"],
    "hero": ["regions", "products", "salespeople", "months"], "notes": ["note", "subject", "text"]}


def revenue_models(spark, d, names=None):
    return models.RevenueModels(
        sales(spark, d, "OrderID", "TotalPrice", *models.CATEGORICAL, *models.REVENUE_NUMBERS),
        trees=TREES, names=names, number=F.col("OrderID"))


def return_models(spark, d, names=None, cross=True):
    return models.ReturnModels(
        sales(spark, d, "OrderID", "Returned", *models.CATEGORICAL, *models.RETURN_NUMBERS),
        trees=TREES, folds=FOLDS, names=names, number=F.col("OrderID"), cross=cross)


def bounded(column: str):
    return F.col(column).between(0, 1)


def clf_leaderboard(spark, d):
    """What is certain of the fitted models: sizes, baseline, that one is best, and that the
    metrics follow from the saved predictions. `clf_scores` has the metrics."""
    fitted = return_models(spark, d)
    board = fitted.leaderboard()
    hits = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    checked = fitted.scored.where("model = 0").groupBy("name").agg(
        F.count(F.lit(1)).alias("predicted"), hits.alias("again"),
        F.count_if(~F.col("score").between(0, 1)).alias("outside"))
    best = board.agg(F.count_if("is_best")).scalar()
    guarded = board.agg(F.count_if(F.col("is_best") & (
        F.col("no_signal") == (F.col("cv_auc") < models.NO_SIGNAL_AUC)))).scalar()
    same = F.abs(F.col("accuracy") - F.col("again")) < 1e-9
    return board.join(checked, F.col("model") == F.col("name"), "left").select(
        "model", F.lit(fitted.n_train).cast("long").alias("n_train"), "predicted",
        F.when(F.col("name").isNull(), F.round("accuracy", 6)).alias("baseline"),
        (same & (F.col("outside") == 0) & bounded("auc") & bounded("cv_auc") &
         bounded("f1_returned")).alias("consistent"),
        best.alias("best_models"), guarded.alias("guarded"))


def reg_leaderboard(spark, d):
    """As `clf_leaderboard`, with the errors taken again from the saved predictions."""
    fitted = revenue_models(spark, d)
    parts = []
    for name, predicted in fitted.predictions.items():
        error = F.col("label") - F.col("prediction")
        parts.append(predicted.agg(
            F.count(F.lit(1)).alias("predicted"), F.round(F.sum("label"), 1).alias("actual"),
            F.avg(F.abs(error)).alias("mae2"), F.sqrt(F.avg(error * error)).alias("rmse2"))
            .withColumn("name", F.lit(name)))
    board = fitted.leaderboard()
    checked = reduce(DataFrame.unionByName, parts)
    best = board.agg(F.count_if(F.col("is_best"))).scalar()
    near = (F.abs(F.col("mae") - F.col("mae2")) < 1e-6 * F.col("mae2") + 1e-9) & (
        F.abs(F.col("rmse") - F.col("rmse2")) < 1e-6 * F.col("rmse2") + 1e-9)
    return board.join(checked, F.col("model") == F.col("name")).select(
        "model", "predicted", "actual", (near & (F.col("r2") <= 1)).alias("consistent"), best.alias("best_models"))


def topk_importance(spark, d):
    """Ten features, best first; the two that make up most of the revenue lead."""
    fitted = revenue_models(spark, d, ["Gradient Boosting"])
    top = fitted.importances("Gradient Boosting", 10)
    lead = F.col("feature").isin("Quantity", "UnitPrice")
    ranked = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("importance"), "feature")))  # ten rows
    return ranked.select(
        "rank", F.col("importance").between(0, 1).alias("is_share"),
        F.when(F.col("rank") <= 2, lead).alias("is_factor"))


def return_importance(spark, d):
    """The ten features the forest of the return models uses most."""
    fitted = return_models(spark, d, ["Random Forest"], cross=False)
    return ranked(fitted.importances("Random Forest", 10))


def revenue_importance(spark, d):
    """The ten features the best revenue model uses most; no rows if it has no importances."""
    top = revenue_models(spark, d).importances(top=10)
    return ranked(spark.createDataFrame([], "feature string, importance double")
                  if top is None else top)


def loaded(spark, fitted: models.Fitted, name: str) -> saved.SavedModel:
    """A model after it was saved and loaded again."""
    path = new_path(spark, "model")
    saved.save_model(fitted, name, path)
    return saved.load_model(spark, path)


def revenue_predictions(spark, d):
    """Actual and predicted revenue of the test side, by the best model, saved and loaded."""
    fitted = revenue_models(spark, d)
    test = fitted.data.rows.where("is_test")
    return loaded(spark, fitted, fitted.best).score(test).select(
        "OrderID", F.lit(fitted.best).alias("model"), F.col("label").alias("actual"),
        F.col("score").alias("predicted"))


def return_probabilities(spark, d):
    """Class and probability of the test side, by each classifier, saved and loaded."""
    fitted = return_models(spark, d, cross=False)
    test = fitted.data.rows.where("is_test")
    return reduce(DataFrame.unionByName, [
        loaded(spark, fitted, name).score(test).select(
            "OrderID", F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
            "prediction", F.col("score").alias("probability"))
        for name in fitted.models])


def ranked(top: DataFrame) -> DataFrame:
    """`rank` by importance; a window over ten rows."""
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("importance"), "feature")))


# -- registry ---------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Orders, revenue, net revenue, average order value and return rate by region."""
    return queries()["by_region"](spark, SMOKE_DIR)


def tuned(query: Query, tables: list[str]) -> Query:
    """Size the shuffles by what the query's growing tables hold."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark, input_bytes(spark, sf_dir, tables))
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "null_normalize_fill": null_normalize_fill,
        "csv_roundtrip": roundtrip("csv"),
        "parquet_roundtrip": roundtrip("parquet"),
        "derive_features": derive_features,
        "dedupe_rows": dedupe_rows,
        "duplicate_rows": duplicate_rows,
        "key_uniqueness": key_uniqueness,
        "profile_shape": lambda s, d: profile.shape(sales(s, d)),
        "profile_nulls": lambda s, d: profile.nulls(raw_sales(s, d)),
        "profile_numeric": lambda s, d: fixed(profile.numeric(sales(s, d, *PROFILED), PROFILED)),
        "profile_categories": lambda s, d: profile.categories(sales(s, d, *CATEGORIES), CATEGORIES),
        "category_counts": lambda s, d: profile.category_counts(
            raw_sales(s, d, *CATEGORIES), CATEGORIES),
        "kpi_global": lambda s, d: fixed(kpi.kpi_global(sales(
            s, d, "TotalPrice", "NetRevenue", "Returned", "DeliveryDays", "ShippingCost")), 1,
            avg_order_value=4, return_rate=4, avg_delivery_days=4),
        "kpi_cards": lambda s, d: fixed_cards(kpi.kpi_cards(sales(
            s, d, "Date", "TotalPrice", "NetRevenue", "Returned", "Quantity", "UnitPrice",
            "Discount"))),
        "hero_counts": lambda s, d: kpi.hero_counts(
            sales(s, d, "Region", "Product", "Salesperson", "Date")),
        **{name: report_by(name) for name in REPORTS},
        "by_promotion_without_null": by_promotion_without_null,
        "delivery_stats": delivery_stats,
        "discount_bucket_aov": lambda s, d: fixed(bd.discount_tiers(
            sales(s, d, "DiscountBucket", "TotalPrice"))),
        "share_of_total": lambda s, d: fixed(bd.share_of_total(
            sales(s, d, "PaymentMethod", "TotalPrice"), ["PaymentMethod"]), revenue=4),
        "vs_overall": lambda s, d: fixed(bd.rate_vs_overall(
            sales(s, d, "Product", "Returned"), "Product")),
        "group_spread": lambda s, d: fixed(bd.group_spread(
            sales(s, d, *RECONCILED, "TotalPrice", "Returned"), RECONCILED),
            min_revenue=4, max_revenue=4, revenue_gap=4),
        "rank_salespeople": rank_salespeople,
        "promo_undiscounted": lambda s, d: fixed(bd.undiscounted_promotions(
            sales(s, d, "Promotion", "Discount"))),
        "monthly": lambda s, d: month_column(fixed(periods.monthly(dated(s, d)), 4)),
        "monthly_filled": lambda s, d: month_column(fixed(periods.monthly_filled(
            dated(s, d, "Salesperson"), ["Salesperson"]), 4), "ds"),
        "monthly_trend": lambda s, d: month_column(fixed(periods.monthly_trend(dated(s, d)), 4)),
        "monthly_stats": lambda s, d: fixed(periods.monthly_stats(dated(s, d)), 2),
        "quarterly": lambda s, d: fixed(periods.quarterly(
            sales(s, d, "Year", "Quarter", "TotalPrice")), 4),
        "annual_flagged": lambda s, d: fixed(periods.annual(dated(s, d)), 4),
        "month_gaps": lambda s, d: month_column(periods.month_gaps(
            dated(s, d, "Salesperson", "CustomerType"), ["Salesperson", "CustomerType"])),
        "like_for_like_year": lambda s, d: month_column(fixed(periods.like_for_like(
            dated(s, d)), 4), "last_date"),
        "like_for_like_half": lambda s, d: month_column(fixed(periods.like_for_like(
            dated(s, d), months=6), 4), "last_date"),
        "like_for_like_observed": lambda s, d: month_column(fixed(periods.like_for_like(
            dated(s, d), drop_last_month=True), 4), "last_date"),
        "same_month_last_year": lambda s, d: month_column(fixed(periods.same_month_last_year(
            dated(s, d, "Region"), ["Region"]), 4), "ds"),
        "rolling3": lambda s, d: month_column(fixed(periods.rolling_mean(dated(s, d)), 4), "ds"),
        "cells": lambda s, d: fixed(crosstab.cells(
            sales(s, d, "Region", "Product", "TotalPrice", "Returned"), "Region", "Product"),
            revenue=4),
        "pivot_revenue": lambda s, d: fixed(crosstab.wide(
            crosstab.cells(sales(s, d, "Region", "Product", "TotalPrice", "Returned"), "Region",
                           "Product"), "Region", "Product", "revenue", PRODUCTS, fill=0.0)
            .orderBy("Region"), 4),
        "pivot_return": lambda s, d: fixed(crosstab.wide(
            crosstab.cells(sales(s, d, "Region", "Product", "TotalPrice", "Returned"), "Region",
                           "Product"), "Region", "Product", "return_rate", PRODUCTS)
            .orderBy("Region")),
        "pivot_product_customer": lambda s, d: fixed(crosstab.by_first_column(crosstab.wide(
            crosstab.cells(sales(s, d, "Product", "CustomerType", "TotalPrice", "Returned"),
                           "Product", "CustomerType").withColumn("k", F.col("revenue") / 1000),
            "Product", "CustomerType", "k", CUSTOMER_TYPES), "Product"), 7),  # four of the revenue
        "grid_reconcile": lambda s, d: fixed(crosstab.grid_difference(
            sales(s, d, "Region", "Product", "TotalPrice", "Returned"), "Region", "Product"), 1, min_cell=4, max_cell=4),
        "chart_levels": lambda s, d: fixed(report.chart_levels(sales(
            s, d, *report.CHART_DIMS, "TotalPrice", "Returned", "Discount", "DeliveryDays")),
            4, revenue_k=2),
        "chart_grids": lambda s, d: fixed(report.grids(sales(
            s, d, "Region", "Product", "CustomerType", "TotalPrice", "Returned")), 4,
            revenue_k=2),
        "corr_matrix": lambda s, d: fixed(stats.correlations(sales(s, d, *CORRELATED), CORRELATED)),
        "chi2_returns": lambda s, d: fixed(stats.return_rate_tests(
            sales(s, d, "Product", "Region", "CustomerType", "Salesperson", "Returned",
                  "TotalPrice"), ["Product", "Region", "CustomerType", "Salesperson"])),
        "trend_fit": lambda s, d: trend_columns(stats.trend_fit(dated(s, d))),
        "trend_fit_by_store": lambda s, d: trend_columns(stats.trend_fit(
            dated(s, d, "StoreLocation"), ["StoreLocation"])),
        "trend_forecast": lambda s, d: month_column(fixed(stats.trend_forecast(
            dated(s, d)), 2, r2=6), "ds"),
        "trend_forecast_by_store": lambda s, d: month_column(fixed(stats.trend_forecast(
            dated(s, d, "StoreLocation"), ["StoreLocation"]), 2, r2=6), "ds"),
        "forecast_width": lambda s, d: fixed(stats.forecast_width(dated(s, d)), 2),
        "checks": lambda s, d: fixed(checks.all_checks(clean.add_derived(raw_sales(s, d))), 1, threshold=2),
        "checks_tally": lambda s, d: checks.tally(checks.all_checks(
            clean.add_derived(raw_sales(s, d)))),
        "reconcile_dims": lambda s, d: fixed(checks.reconcile(
            clean.add_derived(raw_sales(s, d)), RECONCILED), 1),
        "target_identity": lambda s, d: fixed(checks.is_identity(
            sales(s, d, "Quantity", "UnitPrice", "Discount", "TotalPrice")), 4),
        "majority_share": lambda s, d: fixed(scores.majority_share(
            sales(s, d, "Returned"), "Returned")),
        "auc_of_score": lambda s, d: fixed(scores.auc(scored(s, d, "Discount")), 9),
        "auc_of_price_by_type": lambda s, d: fixed(scores.auc(
            scored(s, d, "TotalPrice"), by=["CustomerType"]), 9),
        "roc_points": lambda s, d: fixed(scores.roc_points(scored(s, d, "TotalPrice"))),
        "accuracy": lambda s, d: fixed(scores.accuracy(guessed(s, d))),
        "confusion": lambda s, d: scores.confusion(guessed(s, d)),
        "class_report": lambda s, d: fixed(scores.class_report(guessed(s, d))),
        "reg_metrics": lambda s, d: fixed(scores.regression_metrics(
            list_price_guess(s, d), ["Region"]), 4),
        "actual_vs_predicted": lambda s, d: fixed(list_price_guess(s, d), 4),
        "category_codes": category_codes,
        "scaler_stats": lambda s, d: fixed(scaler_stats(s, d), 7),
        "report_tables": report_tables,
        "note_returns": lambda s, d: fixed(notes.return_rate_note(sales(
            s, d, "Product", "Region", "Salesperson", "TotalPrice", "Returned"))),
        "note_year": lambda s, d: month_column(fixed(notes.partial_year_note(
            dated(s, d)), 4), "last_date"),
        "note_promotions": lambda s, d: fixed(notes.promotion_note(
            sales(s, d, "Promotion", "Discount"))),
        "notes": lambda s, d: notes.all_notes(sales(
            s, d, "Date", "Product", "Region", "Salesperson", "Promotion", "TotalPrice",
            "Returned", "Discount")),
        "model_split": model_split,
        "clf_leaderboard": clf_leaderboard,
        "reg_leaderboard": reg_leaderboard,
        "topk_importance": topk_importance,
        "cleaning_path": cleaning_path,
        "quarantine": quarantine,
        "copy_differences": copy_differences,
        "sketched_medians": sketched_medians,
        "money_scale": lambda s, d: checks.money_scale(sales(
            s, d, "TotalPrice", "NetRevenue", "ShippingCost", "UnitPrice"),
            ["TotalPrice", "NetRevenue", "ShippingCost", "UnitPrice"]),
    }
    found = {name: tuned(query, FACT) for name, query in (q | model_results()).items()}
    if llm_queries:
        texts = llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
        found |= {name: tuned(query, TEXTS) for name, query in texts.items()}
    return found


def model_results() -> dict[str, Query]:
    """What the fitted models give, in full; no SQL can express it, so brute force checks it."""
    return {
        "clf_scores": lambda s, d: return_models(s, d).leaderboard(),
        "reg_scores": lambda s, d: revenue_models(s, d).leaderboard(),
        "return_importance": return_importance,
        "revenue_importance": revenue_importance,
        "revenue_predictions": revenue_predictions,
        "return_probabilities": return_probabilities}


def trend_columns(fit: DataFrame) -> DataFrame:
    out = fixed(fit, 2, r=6, r2=6)
    return month_column(month_column(out, "first_ds"), "last_ds")


def oracle_sql() -> dict[str, str]:
    sql = oracles.all_sql()
    if llm_queries:
        sql |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql

"""Data checks as rows: check, status, observed value, threshold, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.derive import DERIVED, month_start, recomputed_revenue, whole_days
from tallymark.functions.numeric import MONEY_DIGITS, ratio, total
from tallymark.operators.clean import hashed_rows, key_uniqueness
from tallymark.operators.periods import every_month
from tallymark.schema import RECONCILED
from tallymark.session import materialise

TOLERANCE = 0.01
EXACT = "decimal(38,6)"  # sums that do not depend on the order of the rows
MAX_SIZE_RATIO = 2.0


def _check(name: str, label: str, observed: Column, threshold: float, ok: Column, detail: Column,
           otherwise: str = "fail") -> Column:
    return F.struct(
        F.lit(name).alias("check"), F.lit(label).alias("label"),
        F.when(ok, "pass").otherwise(otherwise).alias("status"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"), detail.alias("detail"))


def _rows(one: DataFrame, checks: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def reconcile(df: DataFrame, dims: list[str]) -> DataFrame:
    """Per dimension: revenue on rows whose key is known against the total.

    Spark keeps null keys as a group, so summing a breakdown's groups always
    gives the total; what a reader of the named groups misses is the revenue
    under a null key. All dimensions come from one aggregation.
    """
    v = F.col("TotalPrice")
    one = df.agg(total(v).alias("_total"),
                 *[total(F.when(F.col(d).isNotNull(), v)).alias(d)
                   for d in dims])
    listed = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("covered"),
                       F.abs(F.col(d) - F.col("_total")).alias("delta")) for d in dims]
    return (one.select("_total", F.explode(F.array(*listed)).alias("c"))
            .select("c.*", F.col("_total").alias("total"))
            .withColumn("status", F.when(F.col("delta") < TOLERANCE, "pass").otherwise("fail")))


def money_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values, finer): how many values have more digits than `total` keeps."""
    def finer(c: str) -> Column:
        v = F.col(c)
        return F.abs(v - F.round(v, MONEY_DIGITS)) > 1e-9 + F.abs(v) * 1e-15

    one = df.agg(*[f(c) for c in columns for f in (
        lambda c: F.count(c).alias(f"n_{c}"), lambda c: F.count_if(finer(c)).alias(f"f_{c}"))])
    listed = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("values"),
                       F.col(f"f_{c}").alias("finer")) for c in columns]
    return one.select(F.explode(F.array(*listed)).alias("c")).select("c.*")


def check_cells(df: DataFrame, sized: list[str]) -> DataFrame:
    """Everything the checks need, per month and level of the `sized` dimensions.

    One pass over the sales; the checks add these few rows up in several ways.
    `Promotion` must be the column before null promotions are filled.
    """
    v = F.col("TotalPrice")
    lead = whole_days(F.col("OrderDate"), F.col("DeliveryDate"))
    return df.groupBy(*sized, month_start(F.col("Date")).alias("Date")).agg(
        F.count(F.lit(1)).alias("n"),
        total(v).alias("TotalPrice"),
        F.max(F.abs(recomputed_revenue() - v)).alias("max_diff"),
        F.count_if(F.col("Promotion").isNull()).alias("no_promo"),
        F.count_if(F.col("DeliveryDate") < F.col("OrderDate")).alias("early"),
        F.min(lead).alias("lead_min"), F.max(lead).alias("lead_max"),
        F.sum(lead).alias("lead_sum"), F.count(lead).alias("leads"),
        F.count_if(v <= 0).alias("bad_price"),
        F.count_if(F.col("Discount").isNull()).alias("no_discount"),
        *[total(F.when(F.col(d).isNotNull(), v)).alias(f"d_{d}") for d in RECONCILED])


def row_checks(cells: DataFrame) -> DataFrame:
    """Checks that need sums, extremes and counts only."""
    added = ["n", "no_promo", "early", "bad_price", "no_discount"]
    one = cells.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added],
        total(F.col("TotalPrice")).alias("total"),
        F.max("max_diff").alias("max_diff"), F.min("lead_min").alias("lead_min"),
        F.max("lead_max").alias("lead_max"), ratio(F.sum("lead_sum"), F.sum("leads")).alias("lead_mean"),
        *[total(F.col(f"d_{d}")).alias(f"d_{d}") for d in RECONCILED])
    worst = F.greatest(F.lit(0.0), *[F.abs(F.col(f"d_{d}") - F.col("total")) for d in RECONCILED])
    c = F.col
    return _rows(one, [
        _check("revenue_arithmetic", "Revenue follows from its factors", c("max_diff"), TOLERANCE,
               F.coalesce(c("max_diff") < TOLERANCE, F.lit(True)),
               F.format_string("largest difference %.4f over %d rows",
                               F.coalesce(c("max_diff"), F.lit(0.0)), c("n"))),
        _check("promotion_complete", "Every row has a promotion", c("no_promo"), 0,
               (c("no_promo") == 0) & (F.abs(c("d_Promotion") - c("total")) < TOLERANCE),
               F.format_string("%d of %d rows without a promotion", c("no_promo"), c("n"))),
        _check("delivery_after_order", "Nothing is delivered before it is ordered", c("early"), 0,
               c("early") == 0,
               F.format_string("%d delivered before ordered; lead time %d to %d days, %.2f on average",
                               c("early"), F.coalesce(c("lead_min"), F.lit(0)),
                               F.coalesce(c("lead_max"), F.lit(0)),
                               F.coalesce(c("lead_mean"), F.lit(0.0)))),
        _check("breakdowns_cover_total", "Known groups hold all revenue", worst, TOLERANCE,
               worst < TOLERANCE,
               F.array_join(F.array_compact(F.array(*[
                   F.when(F.abs(c(f"d_{d}") - c("total")) >= TOLERANCE, d) for d in RECONCILED])),
                   ", ")),
        _check("positive_price", "No row with a price of zero or less", c("bad_price"), 0,
               c("bad_price") == 0, F.format_string("%d rows", c("bad_price"))),
        _check("discount_known", "Every row has a discount", c("no_discount"), 0,
               c("no_discount") == 0, F.format_string("%d rows without one", c("no_discount"))),
    ])


def uniqueness_check(df: DataFrame, key: str = "OrderID") -> DataFrame:
    """No duplicate rows and a unique key, from one read of narrow rows.

    Equal rows have the same key, so rows are grouped by key and 128 bits of hash. Derived
    columns follow from the others and are left out.
    """
    given = [c for c in df.columns if c not in DERIVED]
    counts = hashed_rows(df, given, key)
    keys = key_uniqueness(counts, key, F.col("n")).select(F.struct("*")).scalar().alias("k")
    both = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")).select(
        "duplicate_rows", keys)
    surplus = F.col("k.rows") - F.col("k.distinct_keys")
    return _rows(both, [_check(
        "no_duplicates", "Orders are unique", F.greatest(surplus, F.col("duplicate_rows")), 0,
        F.col("k.is_unique") & (F.col("duplicate_rows") == 0),
        F.format_string("%d rows, %d keys, %d duplicate rows", F.col("k.rows"),
                        F.col("k.distinct_keys"), F.col("duplicate_rows")))])


def series_check(df: DataFrame) -> DataFrame:
    """Every month between the first and the last has sales; a gap is a warning."""
    one = every_month(df).agg(
        F.count_if(~F.col("is_gap")).alias("seen"), F.count_if("is_gap").alias("gaps"),
        F.date_format(F.min("month"), "yyyy-MM").alias("first"),
        F.date_format(F.max("month"), "yyyy-MM").alias("last"),
        F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("is_gap"), F.date_format("month", "yyyy-MM")))), ", ").alias("missing"))
    return _rows(one, [_check(
        "months_without_gap", "Every month has sales", F.col("gaps"), 0, F.col("gaps") == 0,
        F.when(F.col("gaps") == 0, F.format_string(
            "%d consecutive months, %s to %s", F.col("seen"), F.col("first"), F.col("last")))
        .otherwise(F.concat(F.lit("missing: "), F.col("missing"))), otherwise="warn")])


def volume_check(cells: DataFrame, sized: list[str],
                 max_ratio: float = MAX_SIZE_RATIO) -> DataFrame:
    """Groups of a dimension have comparable numbers of rows."""
    level = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in sized]))
    sizes = (cells.select("n", level.alias("l")).where(F.col("l.level").isNotNull())
             .groupBy("l.dim", "l.level").agg(F.sum("n").alias("n"))
             .groupBy("dim").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    one = sizes.agg(F.max(F.col("hi") / F.col("lo")).alias("ratio"),
                    F.array_join(F.sort_array(F.collect_list(
                        F.format_string("%s %d-%d", "dim", "lo", "hi"))), ", ").alias("detail"))
    return _rows(one, [_check(
        "comparable_volume", "Groups are of similar size", F.col("ratio"), max_ratio,
        F.coalesce(F.col("ratio") <= max_ratio, F.lit(True)), F.col("detail"),
        otherwise="warn")])


def all_checks(df: DataFrame, key: str = "OrderID", sized: list[str] | None = None,
               max_ratio: float = MAX_SIZE_RATIO) -> DataFrame:
    """Every check on sales whose promotion is not yet filled."""
    sized = sized or ["Product", "Region"]
    cells = materialise(check_cells(df, sized), "check-cells")
    parts = [uniqueness_check(df, key), row_checks(cells), series_check(cells),
             volume_check(cells, sized, max_ratio)]
    return reduce(DataFrame.unionByName, parts)


def tally(checks: DataFrame) -> DataFrame:
    """Number of passes, warnings and failures; warnings do not fail the whole."""
    return checks.agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "warn").alias("warned"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.when(F.count_if(F.col("status") == "fail") == 0, "pass").otherwise("fail")
        .alias("overall"))


def compare_copies(source: DataFrame, copy: DataFrame, dims: list[str]) -> DataFrame:
    """Round-trip check: totals per dimension of a table and its re-read copy.

    The two sides add their rows up in different orders, so the sums are exact
    decimals: with doubles a large total would differ by more than a cent.
    """
    v = F.col("TotalPrice")
    names = ["rows", "nulls", "diff", "total", *dims]

    def summary(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("Promotion").isNull()).alias("nulls"),
            F.max(F.abs(recomputed_revenue() - v)).alias("diff"),
            F.sum(v.cast(EXACT)).alias("total"),
            *[F.sum(F.when(F.col(d).isNotNull(), v.cast(EXACT))).alias(d)
              for d in dims]).withColumn("_side", F.lit(side))

    both = summary(source, "a").unionByName(summary(copy, "b")).agg(*[
        F.max(F.when(F.col("_side") == side, F.col(n))).alias(f"{side}_{n}")
        for side in ("a", "b") for n in names])
    c = F.col

    def row(item: str, expected: Column, found: Column, tolerance: float) -> Column:
        delta = F.abs(F.coalesce(found, F.lit(0)) - F.coalesce(expected, F.lit(0)))
        return F.struct(
            F.lit(item).alias("item"), expected.cast("double").alias("expected"),
            found.cast("double").alias("found"),
            F.when(delta <= tolerance, "OK").otherwise("MISMATCH").alias("status"))

    return (both.select(F.explode(F.array(
        row("rows", c("a_rows"), c("b_rows"), 0),
        row("promotion_nulls", F.lit(0), c("b_nulls"), 0),
        *[row(f"total_by_{d}", c("a_total"), c(f"b_{d}"), TOLERANCE) for d in dims],
        row("arithmetic_difference", F.lit(0.0), c("b_diff"), TOLERANCE))).alias("r"))
        .select("r.*"))


def is_identity(df: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Whether the revenue target follows exactly from three of its features."""
    diff = F.max(F.abs(recomputed_revenue() - F.col("TotalPrice")))
    return (df.agg(F.count(F.lit(1)).alias("lines"), diff.alias("max_difference"))
            .withColumn("target_leakage", F.coalesce(F.col("max_difference") < tolerance,
                                                     F.lit(False))))

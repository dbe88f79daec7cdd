"""Explanations that go with a table, with the numbers they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.breakdown import (level_totals, promotion_measures,
                                           undiscounted_from_levels, undiscounted_promotions)
from tallymark.operators.periods import like_for_like
from tallymark.operators.stats import chi_square
from tallymark.functions.derive import currency, percent, squeeze
from tallymark.functions.numeric import ratio, total
from tallymark.session import materialise

TESTED = ["Product", "Region", "Salesperson"]


def return_rate_note(df: DataFrame, subject: str = "Product",
                     tested: list[str] | None = None) -> DataFrame:
    """Spread of the subject's return rates and whether it is more than noise."""
    tested = tested or TESTED
    levels = materialise(level_totals(df, sorted({subject, *tested})), "levels")
    return levels_note(levels, subject, tested)


def levels_note(levels: DataFrame, subject: str, tested: list[str]) -> DataFrame:
    """The note from the written totals per level, which it reads more than once."""
    levels = levels.where(F.col("dim").isin([subject, *tested]))
    rate = ratio(F.col("returned"), F.col("rated")) * 100
    one = (levels.where((F.col("dim") == subject) & F.col("level").isNotNull())
           .withColumn("rate", rate).agg(
               F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
               F.floor(F.avg("lines")).alias("lines_per_level"),
               F.min(F.struct(-F.col("rate"), F.col("level")))["level"].alias("highest_level")))
    tests = chi_square(levels)
    p = tests.agg(F.struct(*[F.max(F.when(F.col("dim") == t, F.col("p_value"))).alias(t)
                             for t in tested])).scalar()
    out = one.withColumn("spread", F.col("max_rate") - F.col("min_rate"))
    for t in tested:
        out = out.withColumn(f"p_{t.lower()}", p[t])
    listed = F.array_join(F.array(*[
        F.format_string(f"{t} p = %.2f", F.col(f"p_{t.lower()}")) for t in tested]), ", ")
    return out.withColumn("text", F.format_string(
        f"{subject} return rates run from %.1f%% to %.1f%% (%.1f points) with about %d rows per "
        f"level; highest is %s. Chi-square: %s; below 0.05 would be a real difference.",
        "min_rate", "max_rate", "spread", "lines_per_level", "highest_level", listed))


def partial_year_note(df: DataFrame, months: int | None = None) -> DataFrame:
    """The last year's apparent change against the like-for-like one."""
    one = like_for_like(df, months)
    return one.withColumn("text", F.concat(
        F.lit("Data ends on "), F.date_format("last_date", "yyyy-MM-dd"),
        F.format_string("; %d has %d months. Against the whole earlier year it looks like ",
                        "year", "last_month"),
        percent(F.col("apparent_pct"), True),
        F.format_string(", over the first %d months of both years it is ", "months_compared"),
        percent(F.col("change_pct"), True), F.lit("; a full year at this pace is "),
        currency(F.col("annualised")), F.lit(".")))


def promotion_note(df: DataFrame) -> DataFrame:
    """Per code, the discount really given and the orders that got none."""
    return promotion_text(undiscounted_promotions(df))


def promotion_text(codes: DataFrame) -> DataFrame:
    return codes.withColumn("text", F.format_string(
        "%s: %.1f%% average discount, %d of %d rows without any.", "promotion",
        "avg_discount_pct", "undiscounted", "lines"))


def all_notes(df: DataFrame, months: int | None = None) -> DataFrame:
    """The three notes as rows `note`, `subject`, `text`."""
    levels = materialise(level_totals(df, [*TESTED, "Promotion"], promotion_measures()), "levels")
    return notes_from(levels, materialise(days_of(df), "days"), months)


def days_of(df: DataFrame) -> DataFrame:
    """Revenue per day, which stands in for the sales in every period report."""
    return df.groupBy(F.to_date("Date").alias("Date")).agg(
        total(F.col("TotalPrice")).alias("TotalPrice"))


def notes_from(levels: DataFrame, days: DataFrame, months: int | None = None) -> DataFrame:
    """The notes from written totals per level and per day."""
    codes = promotion_text(undiscounted_from_levels(levels))
    return (
        levels_note(levels, "Product", TESTED).select(
            F.lit("returns").alias("note"), F.lit("Product").alias("subject"), "text")
        .unionByName(partial_year_note(days, months).select(
            F.lit("partial year").alias("note"),
            F.col("year").cast("string").alias("subject"), "text"))
        .unionByName(codes.select(
            F.lit("promotions").alias("note"), F.col("promotion").alias("subject"), "text"))
        .withColumn("text", squeeze(F.col("text"))))

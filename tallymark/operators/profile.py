"""Shape, nulls, numeric summary and category levels of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ordered import exact_quantiles
from tallymark.session import materialise


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row count."""
    described = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"),
                          F.lit(t).alias("type")) for i, (n, t) in enumerate(df.dtypes)]
    return (df.agg(F.count(F.lit(1)).alias("rows"))
            .select("rows", F.explode(F.array(*described)).alias("c")).select("c.*", "rows"))


def nulls(df: DataFrame) -> DataFrame:
    """Null count per column, from one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    listed = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    return (one.select("_rows", F.explode(F.array(*listed)).alias("c"))
            .select("c.*", F.col("_rows").alias("rows")))


def numeric(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column.

    Quartiles are exact and interpolated. `approximate` takes them from a
    sketch in the same pass instead.
    """
    if not approximate:  # read more than once below
        df = materialise(df.select(*columns), "profile-columns")
    cast = [F.col(c).cast("double") for c in columns]
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    parts = []
    for name, c in zip(columns, cast):
        parts += [F.count(c).alias(f"n_{name}"), F.avg(c).alias(f"a_{name}"),
                  F.stddev_samp(c).alias(f"s_{name}"), F.min(c).alias(f"l_{name}"),
                  F.max(c).alias(f"h_{name}")]
        if approximate:
            parts.append(F.percentile_approx(c, quarters, 10_000).alias(f"q_{name}"))
    listed = [F.struct(
        F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n"), F.col(f"a_{c}").alias("mean"),
        F.col(f"s_{c}").alias("std"), F.col(f"l_{c}").alias("min"), F.col(f"h_{c}").alias("max"),
        *([F.col(f"q_{c}").alias("q")] if approximate else [])) for c in columns]
    summary = df.agg(*parts).select(F.explode(F.array(*listed)).alias("c")).select("c.*")
    if not approximate:
        found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        at = [F.max(F.when(F.col("probability") == p, F.col("value"))) for p in (0.25, 0.5, 0.75)]
        quartiles = found.groupBy("metric").agg(F.array(*at).alias("q"))
        summary = summary.join(quartiles, "metric", "left")
    return summary.select("metric", "n", "mean", "std", "min", F.col("q")[0].alias("p25"),
                          F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every distinct value of every column with its row count, long form."""
    listed = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns]))
    return (df.select(listed.alias("c")).groupBy("c.column", "c.value")
            .agg(F.count(F.lit(1)).alias("lines")))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values and null rows per column."""
    return categories(df, columns).groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("lines"))), F.lit(0))
        .alias("null_rows"))

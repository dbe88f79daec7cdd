"""Two-way tables: long form first, wide form on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numeric import total


def cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Revenue, rows and return rate (percent) for every pair that occurs."""
    return df.groupBy(row, column).agg(
        total(F.col("TotalPrice")).alias("revenue"), F.count(F.lit(1)).alias("lines"),
        (F.avg("Returned") * 100).alias("return_rate"))


def wide(long: DataFrame, row: str, column: str, value: str, columns: list,
         fill: float | None = None, drop_null_keys: bool = False) -> DataFrame:
    """A long table with the given values of `column` as columns, read once.

    Cells that are missing are null or `fill`. A null row key is a row of its own, and cells
    with a null column key are the column `null`, unless `drop_null_keys`. The list is the
    caller's, as columns are part of the query; use the long form for a list that may grow.
    """
    names = [F.when(F.col(column).isNull(), "null").otherwise(F.col(column).cast("string"))
             .alias("_c")]
    listed = [str(c) for c in columns] + ([] if drop_null_keys else ["null"])
    if drop_null_keys:
        long = long.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    out = long.select(row, *names, F.col(value).alias("_v")).groupBy(row).pivot(
        "_c", listed).agg(F.max("_v"))
    return out if fill is None else out.na.fill(fill, subset=listed)


def by_first_column(df: DataFrame, row: str) -> DataFrame:
    """Sort a wide table by its first value column, highest first."""
    first = next(c for c in df.columns if c != row)
    return df.orderBy(F.col(f"`{first}`").desc_nulls_last(), row)


def grid_difference(df: DataFrame, row: str, column: str) -> DataFrame:
    """Sum of the grid's cells against the total; pairs with a null key count as missing."""
    inside = F.col(row).isNotNull() & F.col(column).isNotNull()
    grid = cells(df, row, column)
    return (grid.agg(F.count_if(inside).alias("cells"),
                     total(F.when(inside, F.col("revenue"))).alias("grid_total"),
                     total(F.col("revenue")).alias("total"),
                     F.min(F.when(inside, F.col("revenue"))).alias("min_cell"),
                     F.max(F.when(inside, F.col("revenue"))).alias("max_cell"))
            .withColumn("difference", F.abs(F.col("grid_total") - F.col("total"))))

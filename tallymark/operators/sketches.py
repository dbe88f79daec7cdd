"""Quantiles and distinct counts of any period, from sketches kept per day and level.

The sales are read once, into a small table that can be stored. A period of any length, for any
of the levels or all of them, merges its days' sketches; no sale is read again. The exact
functions of `ordered`, `profile` and `kpi` stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.numeric import total

# Size of the sketches: of quantiles, and the logarithm of that of distinct counts.
K, LG_K = 400, 14


def rank_error(k: int = K) -> float:
    """Bound of the error of a rank, as a share of all values, that 99 of 100 sketches of size k
    keep, merged or not (published for this kind of sketch)."""
    return 2.296 / k ** 0.9723


def count_error(lg_k: int = LG_K) -> float:
    """Bound of the relative error of a distinct count: three standard errors."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def daily_sketches(df: DataFrame, levels: list[str], value: str = "TotalPrice",
                   key: str = "OrderID") -> DataFrame:
    """(day, levels, lines, revenue, values, keys): one row per day and combination of levels."""
    number = F.col(value).cast("double")
    known = F.when(~F.isnan(number), number)
    return df.groupBy(F.to_date("Date").alias("day"), *levels).agg(
        F.count(F.lit(1)).alias("lines"), total(F.col(value)).alias("revenue"),
        F.kll_sketch_agg_double(known, K).alias("values"),
        F.hll_sketch_agg(F.col(key).cast("string"), LG_K).alias("keys"))


def merged(sketches: DataFrame, by: list[str] | None = None, first_day=None, last_day=None) -> DataFrame:
    """The sketches of a period (both days included; None leaves that side open) merged to `by`."""
    if first_day is not None:
        sketches = sketches.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        sketches = sketches.where(F.col("day") <= F.lit(last_day).cast("date"))
    return sketches.groupBy(*(by or [])).agg(
        F.sum("lines").alias("lines"), total(F.col("revenue")).alias("revenue"),
        F.kll_merge_agg_double("values", K).alias("values"), F.hll_union_agg("keys").alias("keys"))


def sketched(rows: DataFrame, probabilities: list[float]) -> DataFrame:
    """Rows of `merged` with `quantiles` in the order of `probabilities` and `distinct_keys` in
    place of their sketches; null quantiles where no value is known."""
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    some = F.kll_sketch_get_n_double("values") > 0
    return rows.withColumns({
        "quantiles": F.when(some, F.kll_sketch_get_quantile_double("values", points)),
        "distinct_keys": F.hll_sketch_estimate("keys")}).drop("values", "keys")

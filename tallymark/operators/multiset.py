"""Where two copies of a table differ, cell by cell, without joining them.

Rows are hashed to 128 bits and added up, so a sum says which rows there are, how often, and
nothing of their order. Sums are kept per year and per bucket of the key's hash; they make a tree
(table, year, bucket) in which equal branches need no further look. Rows of unequal buckets are
added up per key and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialise

BUCKETS = 4096  # per year
LOW = 0xFFFFFFFF


def limbs(h: Column) -> list[Column]:
    """The two halves of a 64-bit hash; sums of some 2^31 of either don't overflow."""
    return [h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)]


def row_hashes(columns: list[str]) -> list[Column]:
    """Four numbers of 32 bits for a whole row; which cells are null counts, too."""
    values = [F.col(f"`{c}`") for c in columns]
    missing = F.concat(*[v.isNull().cast("int").cast("string") for v in values])
    return [*limbs(F.xxhash64(missing, *values)), *limbs(F.xxhash64(*reversed(values), missing, F.lit(1)))]


def leaves(df: DataFrame, key: str, year: str) -> DataFrame:
    """(year, bucket, rows, s0 to s3) of one copy: one aggregate, a row per year and bucket."""
    sums = [F.sum(h).alias(f"s{i}") for i, h in enumerate(row_hashes(df.columns))]
    return materialise(df.groupBy(
        F.col(year).alias("year"), bucket(key).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), *sums), "leaves")


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def level(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The nodes of one level of the tree at which the copies differ, and their rows."""
    names = ["rows", "s0", "s1", "s2", "s3"]
    signed = left.unionByName(right.select(
        "year", "bucket", *[(-F.col(n)).alias(n) for n in names]))
    sums = signed.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    return sums.where(" OR ".join(f"{n} <> 0" for n in names)).select(
        *keys, F.col("rows").alias("surplus_rows"))


def differences(left: DataFrame, right: DataFrame, key: str = "OrderID", year: str = "Year") -> DataFrame:
    """(key, column, left_rows, right_rows) of each key and column whose cells differ.

    A key may have many rows; their cells are compared as multisets, so rows of a key that trade
    whole rows are equal, and cells that two keys trade are not. `right` is cast to the types of
    `left`; a column it lacks is an error. Equal copies cost one aggregate each.
    """
    right = right.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in left.dtypes])
    sums = [leaves(df, key, year) for df in (left, right)]
    empty = left.select(F.col(key), F.lit("").alias("column"), F.lit(0).cast("long").alias("left_rows"),
                        F.lit(0).cast("long").alias("right_rows")).limit(0)
    if level(*sums).isEmpty():
        return empty
    wrong = materialise(level(*sums, "year", "bucket").select(
        F.col("year").alias("_year"), F.col("bucket").alias("_leaf")), "unequal-leaves")

    def rows(df: DataFrame, sign: int) -> DataFrame:
        inside = df.withColumn("_bucket", bucket(key))
        same = F.col(year).eqNullSafe(F.col("_year")) & (F.col("_bucket") == F.col("_leaf"))
        return inside.join(wrong, same, "left_semi").drop("_bucket").withColumn("_sign", F.lit(sign))

    both = rows(left, 1).unionByName(rows(right, -1))
    cells = {c: limbs(F.xxhash64(F.col(f"`{c}`").isNull(), f"`{c}`")) for c in left.columns if c != key}
    found = both.groupBy(key).agg(
        F.count_if(F.col("_sign") > 0).alias("left_rows"), F.count_if(F.col("_sign") < 0).alias("right_rows"),
        *[F.sum(F.col("_sign") * h).alias(f"_{i}_{n}") for n, c in enumerate(cells) for i, h in enumerate(cells[c])])
    unequal = F.array_compact(F.array(*[
        F.when((F.col(f"_0_{n}") != 0) | (F.col(f"_1_{n}") != 0), F.lit(c)) for n, c in enumerate(cells)]))
    return found.select(key, F.explode(unequal).alias("column"), "left_rows", "right_rows")

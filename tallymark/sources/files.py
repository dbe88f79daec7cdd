"""Read raw and cleaned order tables, write cleaned ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.clean import judged, normalise_nulls
from tallymark.schema import NULL_TOKENS, clean_schema, raw_schema
from tallymark.session import settings

CSV_ROWS = 1 << 20
# Files a task writes at once: so many years need no sort.
WRITERS, YEARS = "spark.sql.maxConcurrentOutputFileWriters", 32

def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             null_tokens: list[str] | None = None) -> DataFrame:
    """CSV with a header and a fixed schema.

    Columns are read as text first: a token such as `NA` is then null in a
    number column as well, and any other text there fails the cast instead of
    turning into null without notice.
    """
    tokens = NULL_TOKENS if null_tokens is None else null_tokens
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    nulled = normalise_nulls(raw, raw.columns, tokens)
    return nulled.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw columns of a CSV with a header, all as text."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in raw_schema().fields])
    return spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite `path` with gzipped CSV files with a header. A file is read by one task, so it holds
    at most CSV_ROWS rows."""
    (df.write.mode("overwrite").option("header", True).option("compression", "gzip")
     .option("maxRecordsPerFile", CSV_ROWS).csv(path))


def write_judged(text: DataFrame, path: str, tokens: list[str] | None = None) -> None:
    """Write rows of text below `path` as accepted and rejected ones, in one pass over them."""
    with settings(text.sparkSession, {WRITERS: "2"}):  # both sides at once, so rows need no sort
        judged(text, tokens).write.mode("overwrite").option("compression", "zstd").partitionBy(
            "rejected").parquet(path)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The typed rows that `write_judged` accepted."""
    return _judged_side(spark, path, False).select(*raw_schema().fieldNames())


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The other rows as text, with `problems`: an array of (column, value, reason)."""
    return _judged_side(spark, path, True).select("raw.*", "problems")


def _judged_side(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in raw_schema().fields])
    problem = T.StructType([T.StructField(n, T.StringType()) for n in ("column", "value", "reason")])
    schema = T.StructType([*raw_schema().fields, T.StructField("problems", T.ArrayType(problem)),
                           T.StructField("raw", text), T.StructField("rejected", T.BooleanType())])
    return spark.read.schema(schema).parquet(path).where(F.col("rejected") == rejected)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, raw_schema())


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(raw_schema()).parquet(path)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, clean_schema())


def read_clean_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(clean_schema()).parquet(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite `path` with the cleaned table.

    CSV is gzipped. Parquet is partitioned by year. A task writes its rows as they come, a file
    per year of its rows, so nothing is shuffled or sorted for it and no year makes a huge task.
    """
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in clean_schema().fields])
    if fmt == "parquet":
        with settings(df.sparkSession, {WRITERS: str(YEARS)}):
            out.write.mode("overwrite").option("compression", "zstd").partitionBy("Year").parquet(path)
    elif fmt == "csv":
        write_csv(out, path)
    else:
        raise ValueError(f"unknown format {fmt!r}")

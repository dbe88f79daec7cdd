"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.session import new_path

# Rows and bytes handed to a Python worker at a time; texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds. Changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a compact table in the shared folder; cuts lineage for lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, function: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Column lists in, column lists out, a batch at a time."""
    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for columns in function(batch.to_pydict()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or with underscores added until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

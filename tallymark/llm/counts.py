"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches, whole_text
from .tokens import encoder


def length_function(path: str):
    """Arrow function: texts in, numbers of tokens out; the ids never leave it."""
    @arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(path, counts_only=True).many(texts.to_pylist()), pa.int64())
    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of `docs`.

    Null and empty texts have 0 tokens. Rows with a null or repeated id are counted like any
    other; other columns are not read. A string that spells a special token counts as that
    token, as the library does by default. Each task encodes batches of about the same number
    of bytes; a text longer than a batch is cut where the tokenizer itself must cut.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), whole_text(text_col))
    counted = rows.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"),
                          length_function(path)("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

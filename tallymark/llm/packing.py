"""Packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text, written
from .tokens import encoder

# Pieces one task packs at a time, so that no task grows with the input.
SHARD_PIECES = 8192
# Sequences filled to at most this share are packed once more, across shards.
OPEN_SHARE = 0.9


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, the longest placed first.

    N[g] open bins have a gap of g. Each length goes where the sum of N[g]^2 gets smallest: a
    new bin, or a bin whose gap g becomes g - length; full bins don't count. Ties take the
    smallest gap. Lengths must lie in 1..capacity.
    """
    n = np.zeros(capacity, np.float64)
    n[0] = -0.5  # closing a bin adds no square: 2 * (n[0] - N[g]) + 2 == 1 - 2 * N[g]
    open_bins: list[list[int]] = [[] for _ in range(capacity)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        best, gap = (2 * n[capacity - size] + 1 if size < capacity else 0.0), capacity
        if size < capacity:
            here = n[size:]
            change = np.where(here > 0, 2 * (n[:capacity - size] - here) + 2, np.inf)
            at = int(change.argmin())
            if change[at] <= best:
                gap = at + size
        if gap == capacity:
            bins[i] = used
            used += 1
        else:
            bins[i] = open_bins[gap].pop()
            n[gap] -= 1
            offsets[i] = capacity - gap
        left = gap - size
        if left:
            open_bins[left].append(int(bins[i]))
            n[left] += 1
    return bins, offsets


def tokenize(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, row, piece, start, length, ids (little-endian
    unsigned integers of the smallest width that fits the vocabulary)."""
    def cut(columns):
        enc = encoder(path)
        width, end = np.dtype(enc.dtype).itemsize, np.array([end_id], enc.dtype).tobytes()
        out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids")}
        for doc_id, row, ids in zip(columns["doc_id"], columns["row"], enc.many(columns["text"])):
            ids += end
            for piece, at in enumerate(range(0, len(ids), capacity * width)):
                part = ids[at:at + capacity * width]
                for k, v in zip(out, (doc_id, row, piece, at // width, len(part) // width, part)):
                    out[k].append(v)
        yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       whole_text(text_col))
    return map_rows(rows, cut, "doc_id {}, row long, piece int, start long, length long, "
                    "ids binary".format(docs.schema[id_col].dataType.simpleString()))


def place(items: DataFrame, keys: list[str], capacity: int, label: str) -> DataFrame:
    """`keys` with shard, bin, at, and fill of the bin. `items` has `keys` and length."""
    shards = max(1, -(-items.count() // SHARD_PIECES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(keys)  # the same placement when a task runs again
        bins, at = sum_of_squares(group["length"].to_numpy(), capacity)
        fill = np.bincount(bins, group["length"].to_numpy()).astype(np.int64)
        return group[[*keys, "shard"]].assign(bin=bins, at=at, fill=fill[bins])

    types = ", ".join(f"{k} {t}" for k, t in items.dtypes if k in keys)
    return written(
        items.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
        .groupBy("shard").applyInPandas(
            pack, f"{types}, shard long, bin long, at long, fill long"), label)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids, sequence_id, offset. Texts are encoded whole
    and end in `end_id`; a null or empty text is that id alone. Rows with a null or repeated id
    are documents of their own. An empty table gives no rows; other columns are not read.

    Only lengths are packed. Shards of bounded size are packed by the sum of squares at the
    same time; what they leave open is packed again in the same way, each open sequence as
    one item. Ids move once, in the last join.
    """
    pieces = written(tokenize(docs, path, end_id, capacity, id_col, text_col), "pieces")
    first = place(pieces.filter(F.col("length") < capacity).select("row", "piece", "length"),
                  ["row", "piece"], capacity, "placed")
    open_bins = (first.filter((F.col("at") == 0) & (F.col("fill") <= OPEN_SHARE * capacity))
                 .select("shard", "bin", F.col("fill").alias("length")))
    second = place(open_bins.withColumnsRenamed({"shard": "shard1", "bin": "bin1"}),
                   ["shard1", "bin1"], capacity, "placed-again")
    again = second.select(
        F.col("shard1").alias("shard"), F.col("bin1").alias("bin"), F.col("at").alias("base"),
        F.struct(F.lit(2).alias("level"), F.col("shard").alias("s"), F.col("bin").alias("b"))
        .alias("to"))
    placed = first.join(again, ["shard", "bin"], "left").select(
        "row", "piece", (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"),
        F.coalesce("to", F.struct(F.lit(1).alias("level"), F.col("shard").alias("s"),
                                  F.col("bin").alias("b"))).alias("to"))
    short = pieces.filter(F.col("length") < capacity).join(placed, ["row", "piece"])
    # Level, shard and place within the shard make the number; full pieces use their row.
    number = (F.col("to.level") * F.lit(1 << 60) + F.col("to.s") * F.lit(1 << 24)
              + F.col("to.b"))
    columns = ["doc_id", "piece", "start", "length", "ids"]
    full = pieces.filter(F.col("length") == capacity).withColumn(
        "one", F.monotonically_increasing_id())
    return short.select(*columns, number.alias("sequence_id"), "offset").unionByName(
        full.select(*columns, F.col("one").alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))

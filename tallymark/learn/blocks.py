"""Rows of a model as blocks of bytes, and sums of arrays over all blocks.

A feature is cut into at most 256 bins once. A block holds some tens of thousands of rows, a
feature after the other, a byte a value; every fit reads blocks only. Rows carry the part they
belong to: a fold of the training side, or the test side. Model 0 learns from all folds and is
judged on the test side; model f + 1 learns from all folds but f and is judged on fold f.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallymark.session import materialise, new_path, settings

# A block's rows, and the rows of a task beyond which there are more tasks than cores.
BINS, BLOCK_ROWS, TASK_ROWS = 256, 1 << 13, 1 << 22
TEST = 255
# Partial sums that one task of the first step of a sum adds up, and the bytes of partial sums
# that go to the driver as they are.
FAN_IN, DIRECT_BYTES = 64, 1 << 25
# Rows handed to a Python worker at a time.
BATCH_ROWS = 1 << 14
# The same where a row is a block: bytes for a worker, rows for the reader.
FEW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 25),
       "spark.sql.parquet.columnarReaderBatchSize": "16"}

SCHEMA = "block long, n int, x binary, z binary, y binary, part binary"


class Block:
    """One block: bins `x` and scaled values `z` (features by rows), labels, parts."""

    def __init__(self, row: dict):
        self.id, self.n = row["block"], row["n"]
        self.y = np.frombuffer(row["y"], np.float64)
        self.part = np.frombuffer(row["part"], np.uint8)
        if row.get("x") is not None:
            self.x = np.frombuffer(row["x"], np.uint8).reshape(-1, self.n)
        if row.get("z") is not None:
            self.z = np.frombuffer(row["z"], np.float64).reshape(-1, self.n)
        self.score = np.frombuffer(row["score"], np.float64).reshape(-1, self.n) \
            if row.get("score") is not None else None

    def learned_by(self, model: int) -> np.ndarray:
        """Which rows a model learns from."""
        own = self.part != TEST
        return own if model == 0 else own & (self.part != model - 1)

    def judged_by(self, model: int) -> np.ndarray:
        return self.part == (TEST if model == 0 else model - 1)


def cut_points(train: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Where the bins of each feature end: half-way between its quantiles in 256 steps, which
    are all its values if it has that many or fewer of some frequency."""
    steps = [i / (BINS - 1) for i in range(BINS)]
    one = train.agg(*[F.percentile_approx(F.col(f"`{n}`"), F.lit(steps), F.lit(10_000)).alias(
        f"q{i}") for i, n in enumerate(names)]).first()
    values = [np.unique(np.array(q if q is not None else [], float)) for q in one]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def make_blocks(rows: DataFrame, names: list[str], cuts: list[np.ndarray], mean: np.ndarray,
                std: np.ndarray, count: int, key: str, scaled: bool = True) -> DataFrame:
    """The written block table of `rows` (label, part, the features, and `key`).

    Rows are dealt by `key` and sorted, so that blocks are the same on every run. Without `scaled`
    there are no scaled values `z`, which take most of a block and which only linear models read.
    """
    scale = np.where(std > 0, std, 1.0)

    def pack(held: list[np.ndarray], number: int) -> pa.RecordBatch:
        data = np.concatenate(held, 1)
        x = np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, data[2:])])
        z = (data[2:] - mean[:, None]) / scale[:, None] if scaled else None
        block = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([data.shape[1]], pa.int32()),
             *(pa.array([None if a is None else a.tobytes()], pa.binary()) for a in (
                 x, z, data[0].copy(), data[1].astype(np.uint8)))], ["block", "n", "x", "z", "y", "part"])

    def run(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            if np.isnan(data).any():
                raise ValueError("a feature or label is null or NaN")
            held.append(data)
            size += data.shape[1]
            if size >= BLOCK_ROWS:
                yield pack(held, number)
                held, size, number = [], 0, number + 1
        if size:
            yield pack(held, number)

    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    tasks = max(min(-(-count // BLOCK_ROWS), spark.sparkContext.defaultParallelism),
                -(-count // TASK_ROWS), 1)
    dealt = rows.repartition(tasks, key).sortWithinPartitions(key, "label", "part", *names)
    return materialise(dealt.select("label", F.col("part").cast("double"), *names).mapInArrow(
        run, SCHEMA), "blocks")


def few_blocks(spark: SparkSession) -> AbstractContextManager[None]:
    """Bound what Spark's reader and a Python worker get at a time where rows are blocks or larger;
    ordinary tables are read as before. Changes no result."""
    return settings(spark, FEW)


def read_blocks(batches) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def array_rows(items: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in items], pa.int64()),
         pa.array([np.ascontiguousarray(a).tobytes() for _, a in items], pa.binary())],
        ["key", "data"])


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays `data` of doubles, added up by `keys`, a row at a time."""
    schema = parts.select(*keys, "data").schema
    batch_schema = to_arrow_schema(schema)

    def run(batches):
        total, last = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                data = np.frombuffer(row["data"], np.float64)
                if key == last:
                    total += data
                    continue
                if last is not None:
                    yield one(last, total)
                last, total = key, data.copy()
        if last is not None:
            yield one(last, total)

    def one(key, total):
        return pa.RecordBatch.from_pylist(
            [dict(zip(keys, key)) | {"data": total.tobytes()}], batch_schema)

    return (parts.select(*keys, "data").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, schema))


def sum_over_blocks(blocks: DataFrame, of_block: Callable[[Block], dict[int, np.ndarray]],
                    columns: list[str], tasks: int | None = None,
                    task_bytes: int | None = None) -> dict[int, np.ndarray]:
    """The sum over all blocks of the arrays `of_block` returns under each number.

    A task adds up its own blocks. The tasks' sums, of at most `task_bytes` each, go to the driver
    if they fit DIRECT_BYTES; else tasks add them up, at most FAN_IN at a time in the first of two
    steps. Arrays are of a size that parameters bound, and so is what the driver gets.
    """
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for block in read_blocks(batches):
            for key, data in of_block(block).items():
                total[key] = total[key] + data if key in total else data
        yield array_rows(list(total.items()))

    tasks = tasks or n_tasks(blocks)
    with few_blocks(blocks.sparkSession):
        return _summed(blocks.select(*columns).mapInArrow(run, "key long, data binary"), tasks, task_bytes)


def _summed(parts: DataFrame, tasks: int, task_bytes: int | None) -> dict[int, np.ndarray]:
    """The tasks' sums `data`, added up by their `key`."""
    if tasks > 1 and (task_bytes is None or tasks * task_bytes > DIRECT_BYTES):
        if tasks > FAN_IN:
            parts = added(parts.withColumn("group", F.spark_partition_id() % -(-tasks // FAN_IN)),
                          ["key", "group"])
        parts = added(parts, ["key"])
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        data = np.frombuffer(r["data"], np.float64)
        out[r["key"]] = out[r["key"]] + data if r["key"] in out else data
    return out


def n_tasks(blocks: DataFrame) -> int:
    """Tasks that read a written block table."""
    return blocks.rdd.getNumPartitions()


def scored_rows(blocks: DataFrame, score: Callable[[Block, int], np.ndarray], models: int,
                columns: list[str], label: str = "scores") -> DataFrame:
    """(model, label, score): every row scored by the model that is judged on its part, written."""
    def run(batches):
        for block in read_blocks(batches):
            for model in range(models):
                own = block.judged_by(model)
                if own.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(own.sum(), model), pa.int32()), pa.array(block.y[own]),
                         pa.array(score(block, model)[own].astype(float))], ["model", "label", "score"])

    with few_blocks(blocks.sparkSession):
        return materialise(blocks.select(*columns).mapInArrow(
            run, "model int, label double, score double"), label)


def new_table(df: DataFrame, label: str) -> DataFrame:
    """`df` written below the shared folder without a second pass over its schema."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

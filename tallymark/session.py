"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


# Run-time settings the joins rely on. They change plans, never results.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split the partitions of a hot join key, also where that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash shuffled sides whose partitions turn out small instead of sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def build_session(master: str | None = None, app: str = "tallymark",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the jobs expect."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


# Input bytes per shuffle partition: jobs shuffle a few narrow columns, some
# tenth of what they read, so a partition gets about 200 MB.
BYTES_PER_PARTITION = 2 * 2 ** 30


def tune(spark: SparkSession, input_bytes: int | None = None) -> None:
    """Give a session built elsewhere the same run-time settings, and its workers the package.

    With the size of the input, AQE also starts from a number of shuffle
    partitions that fits it (100 TB: 51,200) and joins small ones afterwards.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    ship(spark)
    if input_bytes:
        start = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                    -(-input_bytes // BYTES_PER_PARTITION))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(start))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Spark's Python workers this package, wherever the session was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallymark-code-")  # read by the driver, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/tallymark-code", "zip", os.path.dirname(here),
                                          os.path.basename(here)))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    A local master, which has no other machines, may name one in `spark.tallymark.local.dir`
    instead; without either it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = spark.conf.get("spark.tallymark.local.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return shared_folder(spark)


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else writes to."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def intermediates() -> int:
    """A mark: what is written after it can be deleted by `release`."""
    return len(_made)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete the intermediate tables made since `mark`, once results that read them are
    written or collected. What is gone already is no error."""
    jvm = spark.sparkContext._jvm
    for path in _made[mark:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _made[mark:]


@atexit.register
def _forget() -> None:
    """Delete at the end of the process what `release` has not; results are written by then."""
    jvm = SparkContext._jvm
    if not _made or jvm is None:
        return
    with contextlib.suppress(Exception):  # the JVM may have gone first
        conf = jvm.org.apache.hadoop.conf.Configuration()
        for path in _made:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Later steps read the files, so a lost executor does not replay the steps
    before, and the planner knows the true size when it picks a join.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run-time settings for the jobs inside; before and after hold what the session has."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def input_bytes(spark: SparkSession, folder: str, tables: list[str]) -> int:
    """Size of the files of `<folder>/<table>.parquet`, from their listing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(conf)
        if files.exists(path):
            total += files.getContentSummary(path).getLength()
    return total

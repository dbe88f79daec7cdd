"""Token ids in files, coded by a canonical length-limited Huffman code.

A file is a run of blocks. A block can be read alone: 4 magic bytes, five little-endian
unsigned 64-bit integers (documents, ids, ids between checkpoints, checkpoints, payload bytes),
then for its documents the doc_id (signed 64 bits), a flag byte (1: no doc_id, 2: goes on from
the block before) and the number of ids (unsigned 32 bits), then the bit offset of each
checkpoint (unsigned 64 bits), then the code bits, most significant first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, small_batches, whole_text, written
from .storage import new_name, open_folder, read_exactly
from .tokens import encoder, id_type, vocabulary_size
from tallymark.session import new_path, settings

# Fixed values of the format.
MAGIC, HEADER = b"THC1", struct.Struct("<5Q")
NO_ID, GOES_ON = 1, 2
LONGEST_CODE = 18
BLOCK_IDS, CHECKPOINT_IDS = 1 << 18, 256
FILE_IDS = 1 << 22  # ids per file, about
# Ids that a task of the writing stage gets, about, and the most tasks that stage has; a task
# with more ids writes more files.
TASK_IDS, MOST_TASKS = 1 << 24, 1 << 16
CODE_FILE = "code-lengths"
# What an executor holds of long rows. Rows that Parquet's reader hands over at a time, all in one
# array per column; and the table of ids: pages small enough that the JVM's collector keeps them
# with other young garbage, and no dictionary, since hardly two rows have the same ids.
READ_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256"}
IDS_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1",
             "parquet.page.size": str(1 << 18), "parquet.enable.dictionary": "false"}


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Length of each symbol's code by package-merge; 0 for symbols that don't occur.

    The lengths have the least total of counts * length of all prefix codes up to `longest`.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    is_leaf = []  # of each level's merged list, longest codes first
    merged = leaves
    is_leaf.append(np.ones(len(leaves), bool))
    for _ in range(longest - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_leaf.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that count up by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        long = int(lengths.max())
        # Left-aligned codes are running sums of the shares of code space used so far.
        share = np.uint64(1) << (long - lengths[order]).astype(np.uint64)
        start = np.cumsum(share) - share
        codes[order] = start >> (long - lengths[order]).astype(np.uint64)
    return codes


class Code:
    """Coder and table-driven decoder for one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.bits = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.bits - self.lengths[order])
        missing = (1 << self.bits) - int(spans.sum())  # only if a single symbol occurs
        self.symbols = np.concatenate([np.repeat(order, spans), np.zeros(missing, np.int64)])
        self.steps = np.concatenate([np.repeat(self.lengths[order], spans),
                                     np.ones(missing, np.int64)])

    def encode(self, ids: np.ndarray, every: int) -> tuple[np.ndarray, bytes]:
        """Bit offsets of each `every`-th id, and the bits."""
        if not len(ids):
            return np.zeros(0, np.uint64), b""
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        word, bit = start >> 6, start & 63
        room = 64 - bit - size  # negative: the code goes on in the next word
        code = self.codes[ids]
        first = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64),
                         code >> np.maximum(-room, 0).astype(np.uint64))
        words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[heads]] = np.add.reduceat(first, heads)  # disjoint bits: a sum is an or
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return (start[::every].astype("<u8"),
                words.astype(">u8").tobytes()[:(int(end[-1]) + 7) // 8])

    def decode(self, bits: bytes, points: np.ndarray, count: int, every: int) -> np.ndarray:
        """`count` ids; all checkpoints are decoded side by side, an id at a time."""
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = points.astype(np.int64)
        out = np.zeros((every, len(at)), np.uint32)
        lanes, last = len(at), count - (len(at) - 1) * every
        keep = np.uint32((1 << self.bits) - 1)
        for step in range(min(every, count)):
            if step == last:  # the last checkpoint has fewer ids
                lanes -= 1
                at = at[:lanes]
            key = (window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & keep
            out[step, :lanes] = self.symbols[key]
            at = at + self.steps[key]
        return out.T.reshape(-1)[:count]


def token_counts(counted: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, from the tasks' own counts; a row per vocabulary entry at most."""
    def add(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(counts, np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = counted.select("counts").mapInArrow(add, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, row, ids), written, and how often each id occurs.

    A task counts the ids it makes and writes the counts as one row behind the others, in a column
    of their own, so a task has one file open."""
    spark = docs.sparkSession
    vocabulary = vocabulary_size(path)
    dtype = id_type(vocabulary)
    end = np.array([end_id], dtype).tobytes()
    schema = "doc_id long, row long, ids binary, counts binary"
    names = ["doc_id", "row", "ids", "counts"]

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = [x + end for x in encoder(path).many(batch.column(2).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=vocabulary)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()),
                 pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()),
             pa.array([total.tobytes()])], names)

    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("row"), whole_text(text_col))
    folder = new_path(spark, "ids")
    with settings(spark, READ_ROWS):
        rows.mapInArrow(run, schema).write.options(**IDS_FILES).parquet(folder)
    read = spark.read.schema(schema).parquet(folder)
    return (read.filter("ids IS NOT NULL").drop("counts"),
            token_counts(read.filter("counts IS NOT NULL"), vocabulary))


def block(docs: list[tuple], code: Code) -> bytes:
    """One block of (doc_id, goes_on, ids)."""
    ids = np.concatenate([d[2] for d in docs]).astype(np.int64)
    points, bits = code.encode(ids, CHECKPOINT_IDS)
    flags = bytes((NO_ID if d[0] is None else 0) | (GOES_ON if d[1] else 0) for d in docs)
    return b"".join([
        MAGIC, HEADER.pack(len(docs), len(ids), CHECKPOINT_IDS, len(points), len(bits)),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(), flags,
        np.array([len(d[2]) for d in docs], "<u4").tobytes(), points.tobytes(), bits])


def read_blocks(stream, code: Code) -> Iterator[list[tuple]]:
    """Lists of (doc_id, goes_on, ids), a block at a time."""
    while magic := stream.read(len(MAGIC)):
        if magic != MAGIC:
            raise ValueError("no block starts here")
        n_docs, n_ids, every, n_points, n_bytes = HEADER.unpack(read_exactly(stream, HEADER.size))
        doc_ids = np.frombuffer(read_exactly(stream, 8 * n_docs), "<i8")
        flags = read_exactly(stream, n_docs)
        sizes = np.frombuffer(read_exactly(stream, 4 * n_docs), "<u4").astype(np.int64)
        points = np.frombuffer(read_exactly(stream, 8 * n_points), "<u8")
        ids = code.decode(read_exactly(stream, n_bytes), points, n_ids, every)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        yield [(None if f & NO_ID else int(d), bool(f & GOES_ON), part)
               for d, f, part in zip(doc_ids, flags, parts)]


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, end it in `end_id`, and write the ids in ascending id order.

    Returns the written list of files: part and number (their order), file, n_docs, n_ids, bytes,
    start (ids in all files before), folder. A null or empty text is `end_id` alone. Null ids come
    first; rows with the same id follow one another in any fixed order. An empty table gives a list
    without files. Ids must be integers.

    The texts are encoded once, and the ids kept as a table; the tasks' counts make the code,
    which has an entry per vocabulary entry and lies once beside the files. A range shuffle orders
    the ids, so the ids of a part follow those of the part before; a part is a run of files of
    bounded size.
    """
    spark = docs.sparkSession
    dtype = id_type(vocabulary_size(path))
    tokens, counts = encoded(docs, path, end_id, id_col, text_col)
    lengths = code_lengths(counts).tobytes()
    folder = folder or new_path(spark, "huffman")
    fs, root = open_folder(folder)
    with fs.open_output_stream(f"{root}/{CODE_FILE}") as out:
        out.write(lengths)

    def write(batches):
        code = Code(np.frombuffer(lengths, np.uint8))
        fs, root = open_folder(folder)
        part = TaskContext.get().partitionId()
        number, before, file = 0, 0, None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = file or File(fs, root, part, code)
                file.add(doc_id, np.frombuffer(ids, dtype))
                if file.n_ids >= FILE_IDS:
                    yield file.closed(number, before)
                    number, before, file = number + 1, before + file.n_ids, None
        if file:
            yield file.closed(number, before)

    tasks = max(1, min(MOST_TASKS, -(-int(counts.sum()) // TASK_IDS)))
    small_batches(spark)
    listed = (tokens.repartitionByRange(tasks, "doc_id", "row")
              .sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
              .mapInArrow(write, "part long, number long, file string, n_docs long, n_ids long, "
                          "bytes long, before long"))
    with settings(spark, READ_ROWS):
        listed = written(listed, "huffman-files")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    return listed.join(parts, "part").select(
        "part", "number", "file", "n_docs", "n_ids", "bytes",
        (F.col("ahead") + F.col("before")).alias("start"), F.lit(folder).alias("folder"))


class File:
    """A file being written, block by block."""

    def __init__(self, fs, root: str, part: int, code: Code):
        self.name = new_name(f"part-{part:06d}", ".thc")
        self.out, self.code, self.part = fs.open_output_stream(f"{root}/{self.name}"), code, part
        self.waiting: list[tuple] = []
        self.size = self.n_docs = self.n_ids = self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_docs, self.n_ids, at = self.n_docs + 1, self.n_ids + len(ids), 0
        while at < len(ids):
            took = ids[at:at + BLOCK_IDS - self.size]
            self.waiting.append((doc_id, at > 0, took))
            at, self.size = at + len(took), self.size + len(took)
            if self.size == BLOCK_IDS:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.bytes += self.out.write(block(self.waiting, self.code))
        self.waiting, self.size = [], 0

    def closed(self, number: int, before: int) -> pa.RecordBatch:
        self.flush()
        self.out.close()
        return pa.RecordBatch.from_pydict({
            "part": [self.part], "number": [number], "file": [self.name], "n_docs": [self.n_docs],
            "n_ids": [self.n_ids], "bytes": [self.bytes], "before": [before]})


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (little-endian unsigned 32 bits).

    `files` is a list that `write_tokens` gave, or some of its rows; one without files gives no
    rows, a row that is there twice gives its documents twice, other columns are not read. Null
    doc_ids are null again.
    """
    def read(batches):
        codes: dict[str, Code] = {}
        for batch in batches:
            for f in batch.to_pylist():
                fs, root = open_folder(f["folder"])
                if f["folder"] not in codes:
                    with fs.open_input_stream(f"{root}/{CODE_FILE}") as stream:
                        codes[f["folder"]] = Code(np.frombuffer(stream.read(), np.uint8))
                with fs.open_input_stream(f"{root}/{f['file']}", buffer_size=1 << 20) as stream:
                    yield from merged(read_blocks(stream, codes[f["folder"]]), f["start"])

    small_batches(files.sparkSession)
    each = files.select("part", "start", "file", "folder")
    return each.repartition(max(1, min(MOST_TASKS, files.count()))).mapInArrow(
        read, "doc_id long, start long, ids binary")


def merged(blocks, start: int) -> Iterator[pa.RecordBatch]:
    """Documents put together again, in batches of bounded bytes."""
    doc_ids, starts, texts, size = [], [], [], 0
    for docs in blocks:
        for doc_id, goes_on, ids in docs:
            part = ids.astype("<u4").tobytes()
            if goes_on:
                texts[-1] += part
            else:
                if size > BATCH_BYTES:
                    yield batch_of(doc_ids, starts, texts)
                    doc_ids, starts, texts, size = [], [], [], 0
                doc_ids.append(doc_id)
                starts.append(start)
                texts.append(part)
            start += len(ids)
            size += len(part)
    yield batch_of(doc_ids, starts, texts)


def batch_of(doc_ids, starts, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
         pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])

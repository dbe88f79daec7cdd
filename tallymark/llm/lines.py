"""Removal of lines that an earlier document already holds.

The index over the duplicated lines is a sharded minimal perfect hash: a shard keeps no line
and no hash table, only bit arrays that give each line hash a number of its own, and at that
number a fingerprint, the number of rows with the line, and the first document.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallymark.session import new_path

from .common import free_name, map_rows, small_batches, written
from .storage import new_name, open_folder

WHITE = b" \t\n\v\f\r"
MIN_POINTS = 10
# Line hashes per shard of the index, and bytes of shards a worker keeps.
SHARD_LINES, KEPT_BYTES = 1 << 17, 64 << 20
# Documents that make a line a duplicate; counts are kept in a byte, up to MOST_COUNTED.
MIN_COUNT, MOST_COUNTED = 2, 255
GAMMA, MAX_LEVELS = 2.0, 64


def line_key(line: bytes) -> bytes | None:
    """The line without outer white space, A-Z lower-cased; None if too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < MIN_POINTS:
        return None
    if len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return key


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lines that count, and (place, fingerprint) of their keys."""
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line_key(line)
        if key is not None:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.array(at, np.int64), pairs


def slot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Gives each of n distinct hashes a number in 0..n-1, and any other hash some number or -1.

    Level by level, the hashes that meet no other in a bit array of twice their number take
    their bit; the rest go on. The number of a hash is the rank of its bit.
    """
    sizes: list[int] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    ranks: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        self, left, below = cls(), hashes, 0
        for level in range(MAX_LEVELS):
            if not len(left):
                return self
            size = max(64, int(GAMMA * len(left)))
            at = slot(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone)
            self.sizes.append(size)
            self.bits.append(packed)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.ranks.append((below + np.cumsum(counts) - counts).astype(np.uint32))
            below += int(alone.sum())
            left = left[~alone[at]]
        raise ValueError("hashes are not distinct")

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            at = slot(hashes[left], level, size)
            byte, bit = bits[at >> 3], at & 7
            hit = (byte >> (7 - bit).astype(np.uint8)) & 1 == 1
            before = np.bitwise_count(byte[hit] >> (8 - bit[hit]).astype(np.uint16))
            out[left[hit]] = ranks[at[hit] >> 3].astype(np.int64) + before
            left = left[~hit]
        return out


def shard_bytes(rows: pd.DataFrame) -> bytes:
    """The arrays of one shard, from columns place, fingerprint, n_rows, first."""
    rows = rows.sort_values(["place", "fingerprint"])
    places = rows["place"].to_numpy().view(np.uint64)
    function = PerfectHash.build(np.unique(places))
    number = function.numbers(places)
    # Two lines may share a place by chance: they follow one another from `first_at` on.
    order = np.argsort(number, kind="stable")
    first_at = np.searchsorted(number[order], np.arange(len(np.unique(number)) + 1))
    out = io.BytesIO()
    np.savez(out, sizes=np.array(function.sizes), first_at=first_at.astype(np.uint32),
             fingerprint=rows["fingerprint"].to_numpy()[order].view(np.uint64),
             count=np.minimum(rows["n_rows"].to_numpy()[order], MOST_COUNTED).astype(np.uint8), first=rows["first"].to_numpy()[order],
             **{f"bits{i}": b for i, b in enumerate(function.bits)},
             **{f"ranks{i}": r for i, r in enumerate(function.ranks)})
    return out.getvalue()


class Shard:
    def __init__(self, data: bytes):
        arrays = np.load(io.BytesIO(data))
        sizes = arrays["sizes"].tolist()
        self.function = PerfectHash(sizes, [arrays[f"bits{i}"] for i in range(len(sizes))],
                                    [arrays[f"ranks{i}"] for i in range(len(sizes))])
        self.first_at = arrays["first_at"].astype(np.int64)
        self.fingerprint, self.count, self.first = (arrays[k] for k in ("fingerprint", "count", "first"))

    def first_documents(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each (place, fingerprint) counts as a line of several documents, and the first."""
        found = np.zeros(len(pairs), bool)
        first = np.zeros(len(pairs), np.int64)
        number = self.function.numbers(pairs[:, 0])
        at = np.where(number >= 0, self.first_at[number], 0)
        end = np.where(number >= 0, self.first_at[number + 1], 0)
        while len(left := np.flatnonzero(~found & (at < end))):
            hit = (self.fingerprint[at[left]] == pairs[left, 1]) & (self.count[at[left]] >= MIN_COUNT)
            found[left[hit]] = True
            first[left[hit]] = self.first[at[left[hit]]]
            at[left] += 1
        return found, first


class Index:
    """Shards in the shared folder; a worker keeps some KEPT_BYTES of them."""

    def __init__(self, folder: str, files: list[str | None]):
        self.folder, self.files = folder, files
        self.kept: OrderedDict[int, tuple[Shard, int]] = OrderedDict()

    def shard(self, number: int) -> Shard:
        if number not in self.kept:
            fs, root = open_folder(self.folder)
            with fs.open_input_stream(f"{root}/{self.files[number]}") as stream:
                data = stream.read()
            self.kept[number] = Shard(data), len(data)
            while len(self.kept) > 1 and sum(s for _, s in self.kept.values()) > KEPT_BYTES:
                self.kept.popitem(last=False)
        self.kept.move_to_end(number)
        return self.kept[number][0]

    def first_documents(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, first = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        where = np.mod(pairs[:, 1].view(np.int64), len(self.files))
        for number in np.unique(where).tolist():
            if self.files[number] is not None:
                at = np.flatnonzero(where == number)
                found[at], first[at] = self.shard(number).first_documents(pairs[at])
        return found, first


_indexes: dict[str, Index] = {}


def kept_index(folder: str, files: list[str | None]) -> Index:
    if folder not in _indexes:
        _indexes.clear()
        _indexes[folder] = Index(folder, files)
    return _indexes[folder]


def line_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, fingerprint, n_rows, first) of each key found in at least two documents."""
    def run(columns):
        ids, all_pairs = [], []
        for doc_id, text in zip(columns["doc_id"], columns["text"]):
            _, pairs = line_hashes((text or "").encode("utf-8", "surrogatepass").split(b"\n"))
            pairs = np.unique(pairs, axis=0) if len(pairs) > 1 else pairs
            ids.append(np.full(len(pairs), doc_id, np.int64))
            all_pairs.append(pairs)
        # One row per key and batch already: most copies of a hot line end here.
        pairs, doc_ids = np.concatenate(all_pairs), np.concatenate(ids)
        order = np.lexsort((doc_ids, pairs[:, 1], pairs[:, 0]))
        pairs, doc_ids = pairs[order], doc_ids[order]
        heads = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(1))[:len(pairs)])
        ends = np.append(heads[1:], len(pairs)) - 1 if len(pairs) else heads
        yield {"place": pairs[heads, 0].view(np.int64), "first": doc_ids[heads],
               "fingerprint": pairs[heads, 1].view(np.int64), "last": doc_ids[ends],
               "n_rows": ends - heads + 1}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    found = map_rows(rows, run, "place long, fingerprint long, first long, last long, n_rows long")
    return (found.groupBy("place", "fingerprint")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"),
                 F.sum("n_rows").alias("n_rows"))
            .filter("first < last").drop("last"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """(folder, file of each shard or None); the shards are files in the shared folder."""
    spark = docs.sparkSession
    lines = written(line_counts(docs, id_col, text_col), "lines")
    shards = max(1, -(-lines.count() // SHARD_LINES))
    folder = new_path(spark, "line-index")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        fs, root = open_folder(folder)
        name = new_name(f"shard-{rows['shard'].iloc[0]:06d}", ".npz")
        with fs.open_output_stream(f"{root}/{name}") as stream:
            stream.write(shard_bytes(rows))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "file": [name]})

    made = written(
        lines.withColumn("shard", F.pmod("fingerprint", F.lit(shards)))
        .groupBy("shard").applyInPandas(build, "shard long, file string"), "line-index-files")
    files: list[str | None] = [None] * shards
    for r in made.collect():  # a file name per shard
        files[r["shard"]] = r["file"]
    return folder, files


def clean_lines(index: tuple, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Struct of text (null stays null), n_lines and n_dropped; reads a text at a time."""
    folder, files = index

    @arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def clean(ids: pa.Array, texts: pa.Array) -> pa.Array:
        table, out = kept_index(folder, files), []
        ids, texts = ids.to_pylist(), texts.to_pylist()
        lines = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]
        probes = [line_hashes(x) if d is not None else (np.zeros(0, np.int64),
                  np.zeros((0, 2), np.uint64)) for d, x in zip(ids, lines)]
        found, first = table.first_documents(np.concatenate([p for _, p in probes]))
        base = 0
        for doc_id, text, own, (at, _) in zip(ids, texts, lines, probes):
            here = slice(base, base + len(at))
            base += len(at)
            drop = set(at[found[here] & (first[here] != (doc_id or 0))].tolist())
            kept = text if not drop else b"\n".join(
                x for i, x in enumerate(own) if i not in drop).decode("utf-8", "surrogatepass")
            out.append({"text": kept, "n_lines": len(own), "n_dropped": len(drop)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()),
                                        ("n_dropped", pa.int64())]))

    return clean(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counts: bool = True) -> DataFrame:
    """`docs` with `text_col` cleaned, and the columns n_lines and n_dropped if `counts`.

    A line whose key (outer white space off, A-Z lower-cased, at least 10 code points) occurs
    in two documents stays only in the one with the smallest id. Documents are told apart by
    id: rows with the same id are one document and drop the same lines. Rows with a null id
    neither keep nor lose a line. Null texts stay null and count as one empty line; texts of
    which all lines go become empty. Other columns are kept as they are, but for columns that
    have the names of the counts. Keys are compared by 128 bits of hash. Ids must be integers.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "cleaned")
    out = docs.withColumn(name, clean_lines(build_index(docs, id_col, text_col), id_col, text_col))
    new = {text_col: F.col(name)["text"]}
    if counts:
        new |= {"n_lines": F.col(name)["n_lines"], "n_dropped": F.col(name)["n_dropped"]}
    return out.withColumns(new).drop(name)

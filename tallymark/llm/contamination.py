"""Documents that hold passages of a benchmark, with words replaced or not.

Seeds are hashes of words under fixed masks that skip some positions, so a replaced word only
spoils the seeds that look at it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, whole_text, written
from .words import WORD_BASE, hashed_words, mixed

# Positions that a seed looks at, chosen so that some seed is untouched wherever 2 of 13, 3 of 15
# or 4 of 20 words are replaced. Items of 5 to 12 words have masks of their own, of which one is
# untouched if 80 % of the words are equal; items of fewer words are whole texts, and one seed.
MASKS = ("11000111", "11010101", "11101001", "10111001")
SHORT_MASKS = ("111", "11011")
# An overlap has this many words, or the whole item if shorter, of which so many are equal.
MIN_OVERLAP, MIN_EQUAL = 13, 0.8
MIN_SHORT = 5
# Words around a document's seed hits that are kept to verify them.
MARGIN = 16
FILTER_BITS = 24  # the filter has 2^24 bits whatever the benchmark's size: 2 MB


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each place where the mask fits."""
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, (len(mask) * 2654435761 + int(mask, 2)) & (2 ** 64 - 1), np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(WORD_BASE) + words[at:at + count]
    return mixed(h)


def masks_for(n_words: int) -> tuple[str, ...]:
    if n_words >= MIN_OVERLAP:
        return MASKS
    return SHORT_MASKS if n_words >= MIN_SHORT else ("1" * n_words,) * (n_words > 0)


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, words) of every item, a row each."""
    def run(columns):
        words = list(hashed_words(columns["text"]))
        yield {"item": columns["item"], "item_id": columns["item_id"], "n": [len(w) for w in words],
               "words": [w.view(np.int64) for w in words]}

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"),
                            F.col(id_col).cast("long").alias("item_id"), whole_text(text_col))
    return written(map_rows(rows, run, "item long, item_id long, n int, words array<long>"),
                   "benchmark-items")


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item, at) of every item, without its words."""
    def run(columns):
        for item, words in zip(columns["item"], columns["words"]):
            for mask in masks_for(len(words)):
                h = seeds(np.array(words, np.int64).view(np.uint64), mask)
                yield {"hash": h.view(np.int64), "at": np.arange(len(h), dtype=np.int32),
                       "item": np.full(len(h), item)}

    return written(map_rows(items.select("item", "words"), run, "hash long, item long, at int"),
                   "benchmark-seeds")


def doc_masks(items: DataFrame) -> tuple[tuple[str, ...], bool]:
    """The masks that some item needs, and whether some item is a whole text."""
    one = items.agg(F.count_if(F.col("n") >= MIN_OVERLAP).alias("long"),
                    F.count_if(F.col("n").between(MIN_SHORT, MIN_OVERLAP - 1)).alias("short"),
                    F.count_if(F.col("n").between(1, MIN_SHORT - 1)).alias("whole")).first()
    return MASKS * (one["long"] > 0) + SHORT_MASKS * (one["short"] > 0), one["whole"] > 0


def filter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (
        h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def seed_filter(spark_seeds: DataFrame) -> np.ndarray:
    """A bit array of fixed size; a hash whose two bits are not set is no seed."""
    def places(batches):
        for batch in batches:
            h = np.array(batch.column(0).to_pylist(), np.int64).view(np.uint64)
            both = np.unique(np.concatenate(filter_places(h)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(both >> 5), pa.array(np.int64(1) << (both & 31))], ["word", "bits"])

    rows = spark_seeds.select("hash").mapInArrow(places, "word long, bits long") \
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2^19 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = filter_places(h)
    ok = (bits[a >> 5] >> (a & 31).astype(np.uint32)) & 1 == 1
    ok[ok] = (bits[b[ok] >> 5] >> (b[ok] & 31).astype(np.uint32)) & 1 == 1
    return ok


def regions(words: np.ndarray, bits: np.ndarray, masks: tuple[str, ...] = MASKS,
            whole: bool = False) -> list[tuple[int, np.ndarray, list, list]]:
    """Start, words, seed places and seed hashes of each stretch of `words` with hits."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if whole and 0 < len(words) < MIN_SHORT:
        masks = (*masks, "1" * len(words))
    for mask in masks:
        h = seeds(words, mask)
        hit = np.flatnonzero(in_filter(bits, h))
        at.append(hit)
        hashes.append(h[hit])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    out = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * MARGIN) + 1):
        if len(part):
            lo = max(0, int(at[part[0]]) - MARGIN)
            hi = min(len(words), int(at[part[-1]]) + len(MASKS[0]) + MARGIN)
            out.append((lo, words[lo:hi], at[part].tolist(), hashes[part].view(np.int64).tolist()))
    return out


def best_overlap(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch (start, end) of which at least `share` is true."""
    prefix = np.concatenate([[0.0], np.cumsum(equal - share)]) + 1e-9 * np.arange(len(equal) + 1)
    lows = np.minimum.accumulate(prefix)
    start = np.searchsorted(-lows, -prefix, side="left")  # the first place as low as each end
    length = np.arange(len(prefix)) - start
    end = int(length.argmax())
    return int(start[end]), end


def overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the item, length, equal words) of the overlap when item word 0 is at `shift`."""
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    equal = words[lo + shift:hi + shift] == item[lo:hi]
    if len(item) < MIN_OVERLAP:  # all of a short item must be in line, and a shorter one the text
        n = int(equal.sum())
        enough = 5 * n >= 4 * len(item) if len(item) >= MIN_SHORT else n == len(item) == len(words)
        return (0, len(item), n) if hi - lo == len(item) and enough else None
    start, end = best_overlap(equal, MIN_EQUAL)
    if end - start < MIN_OVERLAP:
        return None
    return lo + start, end - start, int(equal[start:end].sum())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, doc_start, item_start, n_words, n_equal): the longest overlap
    of each row of `docs` with each item, places counted in lower-cased words.

    An overlap has at least 13 words in line with the item, 80 % of them equal. Of an item of 5
    to 12 words all are in line, 80 % of them equal; an item of fewer words must be the whole text.
    Null or empty texts and items overlap nothing. Rows and items with null or repeated ids are searched like any
    other; text_hash (xxhash64 of the text, '' for null) tells rows with the same id apart.
    Other columns are not read; an empty table gives no rows.

    Documents are read once. A filter of fixed size drops places that are no seed; the rest
    are joined with the seeds by hash, and the distinct alignments verified word by word.
    """
    items = item_words(benchmark, item_id_col, item_text_col)
    test = item_seeds(items)
    masks, whole = doc_masks(items)
    bits = seed_filter(test)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(columns):
        out = {k: [] for k in ("row", "doc_id", "text_hash", "region", "lo", "words",
                               "ats", "hashes")}
        for row, doc_id, text_hash, words in zip(columns["row"], columns["doc_id"],
                                                 columns["text_hash"],
                                                 hashed_words(columns["text"])):
            for number, (lo, part, ats, hashes) in enumerate(regions(words, shared.value, masks, whole)):
                for k, v in zip(out, (row, doc_id, text_hash, number, lo, part.view(np.int64),
                                      ats, hashes)):
                    out[k].append(v)
        yield out

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col)) \
        .withColumn("text_hash", F.xxhash64("text"))
    found = written(map_rows(
        rows, run, "row long, doc_id long, text_hash long, region int, lo int, words array<long>, "
        "ats array<int>, hashes array<long>"), "benchmark-hits")
    hits = found.select("row", "region", "lo", F.explode(F.arrays_zip("ats", "hashes")).alias("h"))
    lines = hits.select("row", "region", "lo", F.col("h.ats").alias("doc_at"),
                        F.col("h.hashes").alias("hash")).join(
        test.select("hash", "item", "at"), "hash").select(
        "row", "region", "item", (F.col("doc_at") - F.col("at") - F.col("lo")).alias("shift")
    ).distinct()
    named = items.select("item", "item_id", F.col("words").alias("item_words"))
    return verified(lines.join(found.select("row", "region", "doc_id", "text_hash", "lo", "words"),
                               ["row", "region"]).join(named, "item"))


def verified(candidates: DataFrame) -> DataFrame:
    def check(columns):
        out = {k: [] for k in ("row", "doc_id", "text_hash", "item", "item_id", "doc_start",
                               "item_start", "n_words", "n_equal")}
        for row, doc_id, text_hash, item, item_id, lo, shift, words, item_words in zip(*(
                columns[k] for k in ("row", "doc_id", "text_hash", "item", "item_id", "lo",
                                     "shift", "words", "item_words"))):
            hit = overlap(np.array(words, np.int64), np.array(item_words, np.int64), shift)
            if hit:
                start, length, equal = hit
                for k, v in zip(out, (row, doc_id, text_hash, item, item_id, lo + shift + start,
                                      start, length, equal)):
                    out[k].append(v)
        yield out

    found = map_rows(candidates, check, "row long, doc_id long, text_hash long, item long, "
                     "item_id long, doc_start int, item_start int, n_words int, n_equal int")
    best = F.struct("n_words", "n_equal", -F.col("doc_start"), -F.col("item_start"))
    kept = F.struct("doc_id", "text_hash", "item_id", "doc_start", "item_start", "n_words", "n_equal")
    return found.groupBy("row", "item").agg(
        F.max_by(kept, best).alias("o")).select("o.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """`docs` without the rows that overlap any item; columns are those of `docs`.

    Rows with a null text stay, and so do repeated ones without an overlap; of rows with the same
    id those with an overlapping text go. An empty table or benchmark drops nothing.
    """
    names = [free_name(docs, n) for n in ("leak_id", "leak_hash")]
    leaks = find_overlaps(docs, benchmark, id_col, text_col).select(
        F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(
        written(leaks, "leaks"), F.col(id_col).cast("long").eqNullSafe(F.col(names[0]))
        & (F.xxhash64(whole_text(text_col)) == F.col(names[1])), "left_anti")

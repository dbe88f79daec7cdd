"""Words that are one edit apart, and the more frequent form of each.

Two words are one edit apart if their common prefix and suffix together reach the longer
length minus one. Words of the longer length M that are, share the first M // 2 code points or
the other M - M // 2 at the end, so tiles are cut from words that share one of the two. A tile
pairs two blocks of such words as padded matrices of code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .jaccard import blocks

RUN = re.compile("[a-zÀ-ÿ]+")
DROP_ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 5, 3, 2
# Words of a block, words and bytes of compared pairs held at a time, and words counted
# before they are handed on.
BLOCK, WORDS_HELD, TILE_BYTES, COUNTED = 2048, 1 << 16, 1 << 23, 1 << 18


# -- vocabulary ---------------------------------------------------------------

def words_of(doc_id: str, text: bytes) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text; some runs lose a code point, by the hash of id and run."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least five code points that occur at least three times."""
    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in words_of(doc_id, text):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield count_batch(counts)
                    counts = {}
        yield count_batch(counts)

    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def count_batch(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


# -- tiles --------------------------------------------------------------------

def shared_parts(words: DataFrame) -> DataFrame:
    """(longer, at_end, part, word, n): the parts by which a word can meet a near one, as one
    of `longer` code points or as the one shorter by one."""
    def parts(longer):
        front = F.floor(longer / 2).cast("int")
        return [F.struct(longer.alias("longer"), F.lit(0).alias("at_end"),
                         F.substring("word", F.lit(1), front).alias("part")),
                F.struct(longer.alias("longer"), F.lit(1).alias("at_end"),
                         F.right("word", longer - front).alias("part"))]

    length = F.char_length("word")
    return words.select("word", "n", F.explode(F.array(
        *parts(length), *parts(length + 1))).alias("p")).select("p.*", "word", "n")


def padded(points: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, from the front and from the end, filled up with 0."""
    start = np.cumsum(length) - length
    inside = np.arange(width) < length[:, None]
    front = np.zeros(inside.shape, points.dtype)
    front[inside] = points
    back = np.zeros(inside.shape, points.dtype)
    at = (start + length - 1)[:, None] - np.arange(width)
    back[inside] = points[at[inside]]
    return front, back


def common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common start of paired rows that differ somewhere."""
    return (one != other).argmax(1)


def near_pairs(words: list[str], partners: tuple[np.ndarray, np.ndarray], longer: int,
               at_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of words that are one edit apart, the longer of `longer` code points.

    Row x of the tile is compared with the rows from partners[0][x] up to partners[1][x]. A
    pair that shares its front is left out where tiles are by the end, so it is found once.
    """
    length = np.array([len(w) for w in words])
    front, back = padded(np.frombuffer("".join(words).encode("latin-1"), np.uint8), length, longer)
    first, last = partners
    count = np.maximum(last - first, 0)
    done = np.cumsum(count)
    step, begin = max(1, TILE_BYTES // longer), 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(done, done[begin] - count[begin] + step, "right")))
        rows = count[begin:end]
        x = np.repeat(np.arange(begin, end), rows)
        y = np.arange(len(x)) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(first[begin:end], rows)
        some = (length[x] == longer) | (length[y] == longer)
        x, y = x[some], y[some]
        prefix, suffix = common(front[x], front[y]), common(back[x], back[y])
        half = longer // 2
        fits = np.where(at_end[x] == 1, (prefix < half) & (suffix >= longer - half), prefix >= half)
        near = fits & (prefix + suffix >= longer - 1)
        yield x[near], y[near]
        begin = end


def tile_matches(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, form, form_n) of the words with near ones in whole tiles of one `longer`,
    sorted by tile and block."""
    keys = np.stack([table.column(k).to_numpy() for k in ("at_end", "part", "i", "j")], 1)
    block, j = table.column("block").to_numpy(), keys[:, 3]
    size = len(block)
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    end = np.repeat(np.append(first[1:], size), np.diff(np.append(first, size)))
    number = np.arange(size)
    one_block = keys[:, 2] == j
    # Blocks of a tile lie one behind the other: the first meets the second, or itself.
    second = end - np.repeat(np.add.reduceat(block == j, first, dtype=np.int64),
                             np.diff(np.append(first, size)))
    start = np.where(one_block, number + 1, np.where(block == j, end, second))
    words = table.column("word").to_pylist()
    n = table.column("n").to_numpy()
    best = pc.sort_indices(table, [("n", "descending"), ("word", "ascending")]).to_numpy()
    place = np.empty(size, np.int64)
    place[best] = number
    count, form = np.zeros(size, np.int64), np.full(size, size)
    for x, y in near_pairs(words, (start, end), table.column("longer")[0].as_py(), keys[:, 0]):
        for one, other in ((x, y), (y, x)):
            np.add.at(count, one, 1)
            np.minimum.at(form, one, place[other])
    has = np.flatnonzero(count)
    found = best[form[has]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in has], pa.string()), pa.array(count[has]),
         pa.array([words[k] for k in found], pa.string()), pa.array(n[found])],
        ["word", "n_near", "form", "form_n"])


def matches(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) from each tile that holds near words of `word`."""
    members = shared_parts(words)
    key = ["longer", "at_end", "part"]
    shared = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max(
        F.char_length("word") == F.col("longer")).alias("full")).filter("size > 1 AND full")
    count = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("word"), F.col("count")).cast("int")
    # Tiles are told apart by a hash of the part: words that don't share it are compared, but
    # never counted.
    work = (members.join(shared, key).withColumn("count", count).withColumn("block", block)
            .select("longer", F.col("at_end").cast("long").alias("at_end"),
                    F.xxhash64("part").alias("part"), "block", "word", "n",
                    F.explode(blocks(F.col("block"), F.col("count"))).alias("b"))
            .select("longer", "at_end", "part", F.col("b.i").cast("long").alias("i"),
                    F.col("b.j").cast("long").alias("j"), F.col("block").cast("long").alias("block"),
                    "word", "n"))
    tile = ["longer", "at_end", "part", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if len(table) < WORDS_HELD and table.column("longer")[0] == table.column("longer")[-1]:
                continue
            whole = np.stack([table.column(k).to_numpy() for k in tile], 1)
            same = (whole == whole[-1]).all(1)  # the last tile may go on
            cut = len(same) - int(same.sum())
            yield from of_each_length(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from of_each_length(pa.Table.from_batches(held))

    small_batches(words.sparkSession)
    return (work.repartition(*tile).sortWithinPartitions(*tile, "block", "word")
            .mapInArrow(run, "word string, n_near long, form string, form_n long"))


def of_each_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
    longer = table.column("longer").to_numpy()
    edges = [0, *(np.flatnonzero(longer[1:] != longer[:-1]) + 1).tolist(), len(longer)]
    for begin, end in zip(edges, edges[1:]):
        if end > begin:
            yield tile_matches(table.slice(begin, end - begin).combine_chunks())


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, root): each root replaced by its own until none has one. A form
    occurs at least twice as often as its word, so there are no rings; the way doubles with each
    round."""
    while True:
        hop = forms.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = written(forms.join(hop, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"),
            F.col("far").isNotNull().alias("changed")), "roots")
        forms = step.drop("changed")
        if step.filter("changed").isEmpty():
            return forms


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary.

    Words are runs of A to Z, a to z and U+00C0 to U+00FF, A to Z lower-cased; a run whose
    crc32 with the document's id is a multiple of 97 loses a code point. `form` is the near word
    that occurs most (of equal ones the first in code-point order) if it occurs at least twice
    as often, else null; `root` ends the chain of forms. Null texts have no words, a null id
    counts as an empty one, repeated rows count again, an empty table gives no rows, and other
    columns are not read.
    """
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    found = matches(words).groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    near = written(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= FORM_FACTOR * F.col("n"),
               F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
        .alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"), "near")
    roots = follow(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

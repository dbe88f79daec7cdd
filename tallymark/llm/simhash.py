"""SimHash fingerprints of texts, and the groups that fingerprints of few differing bits form.

Distinct fingerprints are the leaves of a binary trie. The join walks pairs of its nodes from
the top, adds up the bits in which the two differ, and leaves a pair as soon as they are more
than the budget. With a budget of three, two fingerprints agree on at least one of their four
quarters; so the trie is walked in four turns of the bits, each time with no difference allowed
on the first quarter, which deals the walk to 65,536 sub-tries a turn. A sub-trie with too many
leaves for a task is walked on by joins of the node table, a few levels at a time, until both
nodes of a pair are small. Tasks return spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, small_batches, written
from .jaccard import components

SHINGLE_WORDS, SEED = 3, 42
BUDGET = 3  # differing bits of linked fingerprints
TURNS, HEAD_BITS = 4, 16
# Leaves of a pair of nodes that one task walks, levels a join descends, and node pairs,
# leaves and shingles handled at a time in a task.
BLOCK, LEVELS = 8192, 4
PAIRS_HELD, LEAVES_HELD, SHINGLES_HELD = 1 << 18, 1 << 17, 1 << 16


# -- fingerprints -------------------------------------------------------------

def fingerprint(text: bytes) -> int:
    """64 bits, each the majority of that bit over the hashes of all shingles of a text."""
    words = text.lower().split()  # of bytes: A to Z, and the six white-space characters
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_HELD):
        part = hashes[at:at + SHINGLES_HELD].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) per row; null and wordless texts get 0."""
    def run(columns):
        made = np.array([fingerprint(t) for t in columns["text"]], np.uint64)
        yield {"doc_id": columns["doc_id"], "print": made.view(np.int64)}

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text), run,
                    "doc_id long, print long")


# -- the walk within a task -----------------------------------------------------

def walk(leaves: np.ndarray, pairs: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of leaves within the budget below pairs of trie nodes.

    `leaves` are 64-bit values, sorted below each node. A pair is (first and end leaf of one
    node, first and end leaf of the other, level, bits they differ in); a node with itself is
    a pair, too. Nodes split where the bit of their level turns to one.
    """
    ones = np.zeros((64, len(leaves) + 1), np.int32)
    for level in range(64):
        np.cumsum((leaves >> np.uint64(63 - level)) & np.uint64(1), out=ones[level, 1:])
    waiting = [pairs]
    while waiting:
        a, a_end, b, b_end, level, bits = waiting.pop()
        if len(a) > PAIRS_HELD:
            half = len(a) // 2
            waiting += [tuple(x[:half] for x in (a, a_end, b, b_end, level, bits)),
                        tuple(x[half:] for x in (a, a_end, b, b_end, level, bits))]
            continue
        single, same = (a_end - a == 1) & (b_end - b == 1), a == b
        i, j = a[single & ~same], b[single & ~same]
        near = np.bitwise_count(leaves[i] ^ leaves[j]) <= BUDGET
        if near.any():
            yield i[near], j[near]
        a, a_end, b, b_end, level, bits, same = (
            x[~single] for x in (a, a_end, b, b_end, level, bits, same))
        if not len(a):
            continue
        a_mid = a_end - (ones[level, a_end] - ones[level, a])
        b_mid = b_end - (ones[level, b_end] - ones[level, b])
        other = ~same  # a node with itself has one mixed pair of children, not two
        children = [(a, a_mid, b, b_mid, level + 1, bits),
                    (a_mid, a_end, b_mid, b_end, level + 1, bits),
                    (a, a_mid, b_mid, b_end, level + 1, bits + 1),
                    tuple(x[other] for x in (a_mid, a_end, b, b_mid, level + 1, bits + 1))]
        below = [np.concatenate(x) for x in zip(*children)]
        keep = (below[0] < below[1]) & (below[2] < below[3]) & (below[5] <= BUDGET)
        waiting.append(tuple(x[keep] for x in below))


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label` (each the smallest number known of its group) after the links (i, j)."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        open_ = low != high
        if not open_.any():
            return label
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def spanning_edges(turn, level, a, b, value) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within the tasks' node pairs; columns sorted by all of them."""
    keys = np.stack([turn, level, a, b], 1)
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    end = np.append(first[1:], len(value))
    leaves = value.view(np.uint64)
    level, a, b, turn = level[first], a[first], b[first], turn
    prefix = leaves >> (64 - np.repeat(level, end - first)).astype(np.uint64)
    left = np.add.reduceat(prefix == np.repeat(a, end - first).view(np.uint64), first, dtype=np.int64)
    whole = a == b
    pairs = (first, np.where(whole, end, first + left), np.where(whole, first, first + left), end,
             level, np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64))
    some = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])
    label = np.arange(len(value))
    for i, j in walk(leaves, tuple(x[some] for x in pairs)):
        label = join_labels(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(label)))
    back = ((TURNS - turn[moved]) % TURNS * HEAD_BITS).astype(np.uint64)
    return turned(leaves[label[moved]], back), turned(leaves[moved], back)


def turned(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The bits of each value turned left by so many places."""
    return ((values << by) | (values >> ((np.uint64(64) - by) % np.uint64(64)))).view(np.int64)


# -- the walk over tasks ----------------------------------------------------------

def prefix(value: Column, level: int) -> Column:
    return F.shiftrightunsigned(value, 64 - level) if level < 64 else value


def turns_of(prints: DataFrame) -> DataFrame:
    """(turn, value): each distinct fingerprint with every quarter in front once."""
    values = [F.col("print")] + [
        F.shiftleft("print", k * HEAD_BITS).bitwiseOR(
            F.shiftrightunsigned("print", 64 - k * HEAD_BITS)) for k in range(1, TURNS)]
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), v.alias("value"))
                      for k, v in enumerate(values)])
    return prints.select(F.explode(turns).alias("t")).select("t.*")


def large_subtries(members: DataFrame, large: DataFrame) -> list[DataFrame]:
    """Work (turn, level, a, b, value) of sub-tries with more than BLOCK leaves.

    Pairs of nodes start as each sub-trie with itself. Every round goes LEVELS down: children
    of both nodes meet if the bits they differ in are still within the budget. A pair of at
    most BLOCK leaves is work for a task; at the last level every node is one leaf.
    """
    head = prefix(F.col("value"), HEAD_BITS)
    inside = written(members.withColumn("head", head).join(large, ["turn", "head"], "left_semi")
                     .select("turn", "value"), "large-subtries")
    pairs = large.select("turn", F.col("head").alias("a"), F.col("head").alias("b"),
                         F.lit(0).alias("bits"))
    work, level = [], HEAD_BITS
    while True:
        level += LEVELS
        child = prefix(F.col("value"), level)
        nodes = written(inside.groupBy("turn", child.alias("child")).agg(
            F.count(F.lit(1)).alias("n")).withColumn(
            "parent", F.shiftrightunsigned("child", LEVELS)), "trie-nodes")
        of_a = nodes.select("turn", F.col("parent").alias("a"), F.col("child").alias("ca"),
                            F.col("n").alias("na"))
        of_b = nodes.select("turn", F.col("parent").alias("b"), F.col("child").alias("cb"),
                            F.col("n").alias("nb"))
        new_bits = F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit(2 ** LEVELS - 1))
        bits = F.col("bits") + F.bit_count(new_bits)
        met = written(
            pairs.join(of_a, ["turn", "a"]).join(of_b, ["turn", "b"])
            .filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
            .withColumn("bits", bits).filter(F.col("bits") <= BUDGET)
            .select("turn", F.col("ca").alias("a"), F.col("cb").alias("b"), "bits",
                    F.when(F.col("ca") == F.col("cb"), F.col("na"))
                    .otherwise(F.col("na") + F.col("nb")).alias("n")), "node-pairs")
        last = level == 64
        ready = met if last else met.filter(F.col("n") <= BLOCK)
        sides = ready.select("turn", "a", "b", F.explode(F.array_distinct(
            F.array("a", "b"))).alias("node"))
        work.append(sides.join(inside.select("turn", child.alias("node"), "value"),
                               ["turn", "node"])
                    .select("turn", F.lit(level).cast("long").alias("level"), "a", "b", "value"))
        pairs = met.filter(F.col("n") > BLOCK).drop("n")
        if last or pairs.isEmpty():
            return work


def trie_edges(prints: DataFrame) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints `print` within the budget."""
    members = written(turns_of(prints), "turns")
    head = prefix(F.col("value"), HEAD_BITS)
    large = written(members.groupBy("turn", head.alias("head")).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).drop("n"), "large")
    work = members.withColumn("a", head)
    more = [] if large.isEmpty() else large_subtries(members, large)
    if more:
        work = work.join(large.withColumnRenamed("head", "a"), ["turn", "a"], "left_anti")
    work = work.select("turn", F.lit(HEAD_BITS).cast("long").alias("level"), "a",
                       F.col("a").alias("b"), "value")
    for part in more:
        work = work.unionByName(part)

    names = ["turn", "level", "a", "b", "value"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(n).to_numpy() for n in names]))
            size += batch.num_rows
            if size >= LEAVES_HELD:
                rows = np.concatenate(held, 1)
                same = (rows[:4] == rows[:4, -1:]).all(0)  # the last task may go on
                cut = len(same) - int(same.sum())
                if cut:
                    yield edge_batch(rows[:, :cut])
                held, size = [rows[:, cut:]], len(same) - cut
        if size:
            yield edge_batch(np.concatenate(held, 1))

    small_batches(prints.sparkSession)
    return (work.repartition("turn", "level", "a", "b").sortWithinPartitions(*names)
            .mapInArrow(run, "u long, v long"))


def edge_batch(rows: np.ndarray) -> pa.RecordBatch:
    u, v = spanning_edges(*(np.ascontiguousarray(x) for x in rows))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))],
                                      ["u", "v"])


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`.

    Words are what stands between white space (space, tab to carriage return), A to Z
    lower-cased; shingles are three words, with repeats; a shorter text is one shingle. A bit of
    the fingerprint is set if it is in more than half of the shingles' XXH64 (seed 42). Null and
    wordless texts have fingerprint 0 and link like any other. component_id is the smallest
    doc_id that links of at most three differing bits reach, null if none of the rows has an id.
    Repeated rows are rows of their own; an empty table gives no rows; columns but the two named
    are not read. Ids must cast to long.
    """
    made = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(made.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    edges = written(trie_edges(nodes).distinct(), "links")
    labels = components(edges).withColumnsRenamed({"node": "print"})
    linked = written(labels.join(nodes, "print"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    reach = nodes.join(linked.select("print", "label").join(least, "label").select(
        "print", "component_id"), "print", "left").select(
        "print", F.coalesce("component_id", "least").alias("component_id"))
    return made.join(reach, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

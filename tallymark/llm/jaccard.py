"""Documents whose sets of five-word shingles overlap by at least 0.8 (Jaccard).

Documents with the same set are one node. Nodes that share a band of MinHash values are
candidates; candidates are compared a few MinHash values at a time and dropped once a
similarity of 0.8 has become too unlikely. What remains is verified on the sets themselves.
No step makes a row per pair: tasks get the members of a bucket or of a cluster, and return
counts per node and one edge per node.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, small_batches, whole_text, written
from .words import hashed_words, mixed, ngram_hashes

SHINGLE_WORDS = 5
# 48 bands of 6 values: a pair of similarity 0.8 shares no band with probability 5e-7.
BANDS, BAND_VALUES = 48, 6
# One byte of each of 128 values is compared, 32 at a time. A pair is dropped when its
# posterior probability of similarity 0.8 or more falls below the tolerance.
COMPARED, STEP, TOLERANCE = 128, 32, 1e-9
THRESHOLD = (4, 5)  # numerator and denominator, so the exact test has no rounding
# Members of a bucket, and shingles of a cluster, that one task compares with as many others.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 30_000

_rng = np.random.Generator(np.random.PCG64(20240101))  # the same hash functions everywhere
FLIPS = _rng.integers(0, 2 ** 64, BANDS * BAND_VALUES, np.uint64)
FACTORS = _rng.integers(0, 2 ** 63, BANDS * BAND_VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SEEDS = _rng.integers(0, 2 ** 64, BANDS, np.uint64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n bytes that leave a posterior of at least `tolerance`.

    A byte matches with probability J + (1 - J) / 256. From a uniform prior on it, the
    posterior of p >= t after m matches is the chance of at most m hits in n + 1 trials of t.
    """
    t = threshold + (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


LEAST = [(n, least_matches(n, THRESHOLD[0] / THRESHOLD[1], TOLERANCE))
         for n in range(STEP, COMPARED + 1, STEP)]


def likely(values: np.ndarray, one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Those of the rows `others` that may be similar to the row `one`, by growing evidence."""
    matches = np.zeros(len(others), np.int64)
    for upto, least in LEAST:
        part = slice(upto - STEP, upto)
        matches += (values[others, part] == one[part]).sum(1)
        keep = matches >= least
        others, matches = others[keep], matches[keep]
        if not len(others):
            break
    return others


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of 1 to 4 words is one shingle."""
    for words in hashed_words(texts):
        if 0 < len(words) < SHINGLE_WORDS:
            yield ngram_hashes(words, len(words)) + np.uint64(len(words))
        else:
            yield np.unique(ngram_hashes(words, SHINGLE_WORDS))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit MinHash values per set; the sets must not be empty."""
    out = np.empty((len(sets), len(FLIPS)), np.uint32)
    begin, size, start = 0, 0, []
    for i, s in enumerate(sets):
        start.append(size)
        size += len(s)
        if size > 1 << 16 or i == len(sets) - 1:
            h = np.concatenate(sets[begin:i + 1])
            for k in range(len(FLIPS)):
                v = ((h ^ FLIPS[k]) * FACTORS[k]) >> np.uint64(32)
                out[begin:i + 1, k] = np.minimum.reduceat(v, start)
            begin, size, start = i + 1, 0, []
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.uint64).reshape(len(values), BANDS, BAND_VALUES)
    key = np.broadcast_to(BAND_SEEDS, wide.shape[:2]).copy()
    for i in range(BAND_VALUES):
        key = mixed(key ^ (wide[:, :, i] + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    pair = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), ">i8")
    return int(pair[0]), int(pair[1])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, k1, k2, size, bands, bytes). A text without words has size 0, no bands,
    and its text hash for a key."""
    def run(columns):
        sets = list(shingle_sets(columns["text"]))
        full = [i for i, s in enumerate(sets) if len(s)]
        values = minhashes([sets[i] for i in full])
        bands = band_keys(values)
        low = np.ascontiguousarray((values[:, :COMPARED] & 0xFF).astype(np.uint8))
        out = {"doc_id": columns["doc_id"], "text_hash": columns["text_hash"],
               "size": [len(s) for s in sets]}
        out |= {"k1": list(columns["text_hash"]), "k2": [0] * len(sets), "bands": [None] * len(sets),
                "bytes": [None] * len(sets)}
        for at, i in enumerate(full):
            out["k1"][i], out["k2"][i] = set_key(sets[i])
            out["bands"][i], out["bytes"][i] = bands[at], low[at].tobytes()
        yield out

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text) \
        .withColumn("text_hash", F.xxhash64("text"))
    return map_rows(rows, run, "doc_id long, text_hash long, k1 long, k2 long, size int, "
                    "bands array<long>, bytes binary")


def blocks(block: Column, count: Column) -> Column:
    """All pairs of blocks that a member of `block` takes part in."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda other: F.struct(
        F.least(block, other).alias("i"), F.greatest(block, other).alias("j")))


def grouped(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            key = tuple(values[begin])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def byte_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COMPARED)


def connect(values: np.ndarray) -> np.ndarray:
    """For each row, the first row that it is connected to by likely pairs."""
    label = np.arange(len(values))
    left = np.arange(len(values))
    while len(left):
        first, left = left[0], left[1:]
        waiting = [first]
        while waiting and len(left):
            near = likely(values, values[waiting.pop()], left)
            if len(near):
                label[near] = first
                waiting += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return label


def bucket_edges(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect what may be similar, at most one per member of a bucket."""
    spark = nodes.sparkSession
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = written(members.join(shared, "key"), "bucket-members")
    count = F.ceil(F.col("n") / F.lit(BUCKET_BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("node"), count).cast("int")
    work = (held.join(nodes.select("node", "bytes"), "node")
            .select("key", "node", "bytes", F.explode(blocks(block, count)).alias("b"))
            .select("key", F.col("b.i").cast("long").alias("i"), F.col("b.j").cast("long").alias("j"),
                    "node", "bytes"))

    def run(batches):
        us, vs = [], []
        for group in grouped(batches, ["key", "i", "j"]):
            node = group.column("node").to_numpy()
            label = connect(byte_rows(group.column("bytes")))
            moved = np.flatnonzero(label != np.arange(len(label)))
            us.append(node[moved])
            vs.append(node[label[moved]])
            if len(us) >= 4096:
                yield edge_batch(us, vs)
                us, vs = [], []
        yield edge_batch(us, vs)

    small_batches(spark)
    return (work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
            .mapInArrow(run, "u long, v long").distinct())


def edge_batch(us: list, vs: list) -> pa.RecordBatch:
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))],
                                      ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (u, v).

    Each round takes the smallest label around a node, then the label of that label; tables
    are written between rounds. Minima combine before they shuffle, so hubs are no burden.
    """
    both = written(edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnsRenamed({"node": "u"}), "u").groupBy(
            F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select(
            "node", "label", F.least("label", "near").alias("next"))
        step = written(step, "labels")
        hop = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = written(step.join(hop, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("label"),
            (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("changed")),
            "labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels


def verified_links(shingles: list[np.ndarray], values: np.ndarray, left: np.ndarray,
                   right: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list]:
    """Weight of all links of each member, and the linked pairs' spanning edges.

    Pairs are of a row in `left` with a later row in `right`. Sets become runs of local
    numbers; a table of the numbers in one set then counts its overlap with many others.
    """
    sizes = np.array([len(s) for s in shingles])
    flat = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(sizes)])
    here = np.zeros(flat.max() + 1, bool)
    links, parent = np.zeros(len(sizes), np.int64), np.arange(len(sizes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    top, bottom = THRESHOLD
    for a in left.tolist():
        others = right[right > a] if len(left) == len(right) and left is right else right
        # Sets of too different size can't be similar.
        small, large = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        others = likely(values, values[a], others[bottom * small >= top * large])
        if not len(others):
            continue
        own = flat[start[a]:start[a + 1]]
        here[own] = True
        for part in np.array_split(others, -(-int(sizes[others].sum()) // 4_000_000)):
            runs = np.concatenate([flat[start[b]:start[b + 1]] for b in part.tolist()])
            heads = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            both = np.add.reduceat(here[runs], heads, dtype=np.int64)
            linked = part[bottom * both >= top * (sizes[a] + sizes[part] - both)]
            links[a] += int(weights[linked].sum())
            links[linked] += weights[a]
            for b in linked.tolist():
                parent[root(b)] = root(a)
        here[own] = False
    return links, [root(i) for i in range(len(sizes))]


def cluster_links(docs: DataFrame, clusters: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, links, other) of the members of `clusters` that have links, by task.

    `clusters` has node, label, doc_id and text_hash of one document with the set, k1, k2, size,
    copies, bytes. Only those documents' shingles are made again.
    """
    total = clusters.groupBy("label").agg(F.sum(F.col("size").cast("long")).alias("total"))
    count = F.ceil(F.col("total") / F.lit(CLUSTER_BLOCK)).cast("int")
    ready = written(clusters.join(total, "label").withColumn("count", count), "clusters")
    text = docs.select(F.col(id_col).cast("long").alias("d"), whole_text(text_col)) \
        .withColumn("h", F.xxhash64("text"))
    wanted = text.join(ready, (F.col("d").eqNullSafe(F.col("doc_id")))
                       & (F.col("h") == F.col("text_hash")))

    def sets(columns):
        made = list(shingle_sets(columns["text"]))
        keep = [i for i, s in enumerate(made)
                if set_key(s) == (columns["k1"][i], columns["k2"][i])]
        out = {k: [columns[k][i] for i in keep] for k in ("label", "node", "copies", "bytes", "count")}
        yield out | {"shingles": [made[i].tobytes() for i in keep]}

    members = map_rows(wanted.select("label", "node", "copies", "bytes", "count", "k1", "k2", "text"),
                       sets, "label long, node long, copies long, bytes binary, count int, "
                       "shingles binary")
    block = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    work = members.withColumn("block", block).select(
        "label", "node", "copies", "bytes", "block", "shingles",
        F.explode(blocks(block, F.col("count"))).alias("b")).select(
        "label", F.col("b.i").cast("long").alias("i"), F.col("b.j").cast("long").alias("j"),
        "node", "copies", "bytes", "block", "shingles")

    def run(batches):
        for group in grouped(batches, ["label", "i", "j"]):
            node = group.column("node").to_numpy()
            first = np.append(True, node[1:] != node[:-1])  # repeated rows are one member
            group, node = group.filter(pa.array(first)), node[first]
            block = group.column("block").to_numpy()
            i, j = (group.column(k)[0].as_py() for k in ("i", "j"))
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            links, root = verified_links(
                [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()],
                byte_rows(group.column("bytes")), left, right, group.column("copies").to_numpy())
            has = np.flatnonzero(links)
            if len(has):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[has]), pa.array(links[has]), pa.array(node[np.array(root)[has]])],
                    ["node", "links", "other"])

    small_batches(docs.sparkSession)
    return (work.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
            .mapInArrow(run, "node long, links long, other long"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, n_shingles, class_node) per row of `docs`.

    n_links counts the other rows with a Jaccard similarity of at least 0.8 of the sets of
    five-word shingles (words: lower-cased letters, digits, underscores; a text of one to four
    words is one shingle). class_id is the smallest doc_id of all rows that links connect, null
    if none has an id. A text without words links to the rows with the very same text alone (null
    counts as empty). Rows with a null or repeated id are nodes of their own text. An empty table gives
    no rows; other columns are not read. text_hash is xxhash64 of the text ('' for null);
    class_node tells classes apart within one result, also where class_id is null.
    """
    made = written(signatures(docs, id_col, text_col), "signatures")
    nodes = written(made.groupBy("k1", "k2", (F.col("size") > 0).alias("worded")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = components(written(bucket_edges(nodes), "candidates"))
    clusters = near.join(nodes, "node").select(
        "node", "label", F.col("one.doc_id").alias("doc_id"),
        F.col("one.text_hash").alias("text_hash"), "k1", "k2", "size", "copies", "bytes")
    found = written(cluster_links(docs, clusters, id_col, text_col), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    same = components(found.filter("node != other").select(
        F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    key = ["k1", "k2", "worded"]
    owner = nodes.select("node", *key, "copies", "least_id").join(
        links, "node", "left").join(same, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    owner = written(owner, "classes")
    ids = owner.groupBy("label").agg(F.min("least_id").alias("class_id"))
    classes = owner.join(ids, "label").select(
        *key, "class_id", F.col("label").alias("class_node"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return made.select("doc_id", "text_hash", "size", "k1", "k2", (F.col("size") > 0).alias("worded")).join(
        classes, key, "left").select(
        "doc_id", "text_hash", "class_id", F.col("n_links").cast("long").alias("n_links"),
        F.col("size").alias("n_shingles"), "class_node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without all but one row of each class: the one with the smallest id (nulls last),
    then the smallest text_hash, stays. A repeated row (same id and text) is the same document. Of
    the rows with the same text without words one stays, too. Columns are those of `docs`."""
    found = similar_documents(docs, id_col, text_col)
    winners = found.groupBy("class_node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("w")
    ).select("w.doc_id", "w.text_hash").distinct()
    names = [free_name(docs, n) for n in ("winner_id", "winner_hash", "own_hash")]
    winners = written(winners.toDF(*names[:2]), "winners")
    kept = docs.withColumn(names[2], F.xxhash64(whole_text(text_col))).join(
        winners, F.col(id_col).cast("long").eqNullSafe(F.col(names[0]))
        & (F.col(names[2]) == F.col(names[1])), "left_semi")
    return kept.dropDuplicates([id_col, names[2]]).drop(names[2])

"""Random forests of full depth whose trees never pass through the driver.

Every tree draws its own rows, a Poisson weight per row. A node with many rows is split by
histograms that tasks sum over the byte blocks, a level at a time: weights are drawn anew and rows
walk down the splits so far, so no rows are written or shuffled for it. As soon as all nodes are
small, the rows of each go to one task, once, which finishes the whole subtree. Subtrees are rows
of a table. The driver knows the splits of large nodes only: their number is that of all drawn
rows over SUBTREE_ROWS. Rows to be scored are dealt to the subtrees they fall in, tree by tree,
and a block's scores are added up over the trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallymark.session import materialise, settings

from .blocks import BINS, Block, added, few_blocks, read_blocks

# Rows of a node that one task finishes: some 400 MB of a Python worker.
SUBTREE_ROWS = 1 << 21
# Bytes of histograms that a task holds at a time.
HELD_BYTES = 1 << 26
# Rows whose cuts are looked for at a time, and rows sorted at a time.
HELD_ROWS, SORTED_ROWS = 1 << 15, 1 << 12
# A row is a whole subtree: rows for the reader.
FEW_SUBTREES = {"spark.sql.parquet.columnarReaderBatchSize": "2"}
NODE = ["model", "tree", "node"]
TIE = 1e-9  # share by which a gain must be larger
PIECE = "task int, model int, tree int, node long, n int, block long, x binary, y binary, labels binary, w binary"
SUBTREE = ("model int, tree int, node long, feature binary, cut binary, below binary, value binary, "
           "gain binary, n_nodes int")
HISTOGRAM = "model int, tree int, node long, data binary"
CHOSEN = ("model int, tree int, node long, feature int, cut int, gain double, left_rows double, "
          "right_rows double")
COLUMNS = ["block", "n", "x", "y", "part"]


# -- one subtree, in a task ------------------------------------------------------

def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([int(k) for k in key])))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(end[-1])


def whole_nodes(end: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of nodes with at most `rows` rows together, or one node; `end` is where each ends."""
    first = 0
    while first < len(end):
        begin = end[first - 1] if first else 0
        last = max(int(end.searchsorted(begin + rows, "right")), first + 1)
        yield first, last
        first = last


def in_order(node: np.ndarray, bins: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys (node and bin) of rows grouped by node, and the places these come from.

    Few rows at a time, so that key and place fit 32 bits: such numbers sort fastest.
    """
    keys, places = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
    for first, last in whole_nodes(end, SORTED_ROWS):
        own = slice(int(end[first - 1]) if first else 0, int(end[last - 1]))
        rows = own.stop - own.start
        bits = (rows - 1).bit_length()
        kind = np.uint32 if bits + (last - first - 1).bit_length() + 8 <= 32 else np.int64
        key = (node[own] - first).astype(kind)
        key <<= kind(8)
        key |= bins[own]
        key <<= kind(bits)
        key |= np.arange(rows, dtype=kind)
        key.sort()
        np.add(key & kind((1 << bits) - 1), own.start, out=places[own])
        np.add(key >> kind(bits), first * BINS, out=keys[own])
    return keys, places


def best_cuts(seen: np.ndarray, weight: np.ndarray, label: np.ndarray, count: np.ndarray, total: np.ndarray,
              before: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(nodes, gain, cut) from the sums per node and bin that occur; `before` and the last value
    are the running sum of the labels so far."""
    node = seen // BINS
    head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    length = np.diff(np.append(head, len(node)))
    first = label[head]
    if before is not None:
        label[0] += before
    left_w, left_y = np.cumsum(weight), np.cumsum(label)
    before, own = left_y[-1], node[head]
    left_w -= np.repeat(left_w[head] - weight[head], length)
    left_y -= np.repeat(left_y[head] - first, length)
    right_w, right_y = np.repeat(count[own], length), np.repeat(total[own], length)
    right_w -= left_w
    right_y -= left_y
    outer = np.append(head[1:], len(node)) - 1  # the last bin of a node is no cut
    right_w[outer] = 1.0
    for y, w in ((left_y, left_w), (right_y, right_w)):
        y *= y
        y /= w
    gain = np.add(left_y, right_y, out=left_y)
    gain[outer] = -np.inf
    best = np.maximum.reduceat(gain, head)
    hit = np.flatnonzero(gain == np.repeat(best, length))
    owner = node[hit]
    hit = hit[np.append(True, owner[1:] != owner[:-1])]
    hit = hit[np.isfinite(gain[hit])]
    at = node[hit]
    return at, gain[hit] - total[at] ** 2 / count[at], seen[hit] % BINS, before


def level_splits(size: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray, count: np.ndarray,
                 total: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, gain, cut): each node's best cut of one feature; nodes without a cut left out.

    Rows are grouped by node, of which `size` has the rows, and given by bin, weight and weighted
    label; `count` and `total` are the nodes' sums of both. `few` nodes get a table of all bins.
    """
    node = np.repeat(np.arange(len(size)), size)
    if few:
        key = node * BINS + bins
        weight = np.bincount(key, w, len(size) * BINS)
        seen = np.flatnonzero(weight)
        label = np.bincount(key, wy, len(size) * BINS)[seen]
        return best_cuts(seen, weight[seen], label, count, total, None)[:3]
    end, before, parts = np.cumsum(size), None, []
    for first, last in whole_nodes(end, HELD_ROWS):
        own = slice(int(end[first - 1]) if first else 0, int(end[last - 1]))
        key, place = in_order(node[own] - first, bins[own], end[first:last] - own.start)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        weight, label = w[own].take(place), wy[own].take(place)
        if len(begin) < len(key):
            weight, label = np.add.reduceat(weight, begin), np.add.reduceat(label, begin)
        at, gain, cut, before = best_cuts(key.take(begin), weight, label, count[first:last],
                                          total[first:last], before)
        parts.append((at + first, gain, cut))
    return tuple(np.concatenate(p) for p in zip(*parts))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tries: int, rng: np.random.Generator,
         depth: int | None = None) -> dict[str, np.ndarray]:
    """A tree over bins `x` (features by rows), grown until nodes are pure or can't be cut.

    Every node tries `tries` features drawn at random, and the others if none of those can cut
    it. Nodes are numbered level by level; the children of i are below[i] and below[i] + 1. Rows
    are kept grouped by node, in their order within a node; those of finished nodes are dropped.
    """
    features = len(x)
    center = float(np.average(y, weights=w)) if len(y) else 0.0
    rows, size, level_start = np.arange(len(y)), np.array([len(y)]), 0
    flat, width = np.ascontiguousarray(x).ravel(), len(y)
    w, wy = w.astype(float), w * (y - center)
    gains = np.zeros(features)
    kinds = {"feature": np.int16, "cut": np.uint8, "below": np.int32, "value": np.float64}
    parts: dict[str, list] = {k: [] for k in kinds}
    level, nodes = 0, 1 if len(y) else 0
    while nodes:
        node, start = np.repeat(np.arange(nodes), size), np.cumsum(size) - size
        count, total = np.bincount(node, w, nodes), np.bincount(node, wy, nodes)
        best, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, np.int64)
        place = places(rng, nodes, features)
        open_ = np.logical_or.reduceat(y != np.repeat(y[start], size), start)
        if depth is not None and level >= depth:
            open_[:] = False
        for turn in range(2 if tries < features else 1):
            for f in range(features):
                chosen = np.flatnonzero(
                    open_ & ((place[:, f] < tries) if not turn else (place[:, f] >= tries) & (feature < 0)))
                if not len(chosen):
                    continue
                held = size[chosen]
                own, own_w, own_wy = rows, w, wy
                if len(chosen) < nodes:
                    use = ranges(start[chosen], held)
                    own, own_w, own_wy = rows.take(use), w.take(use), wy.take(use)
                found, gain, at = level_splits(held, x[f].take(own), own_w, own_wy, count[chosen], total[chosen],
                                               nodes * BINS <= 2 * len(own))
                found = chosen[found]
                more = gain > best[found] + TIE * np.abs(gain)  # ties: the first feature
                found, gain, at = found[more], gain[more], at[more]
                best[found], feature[found], cut[found] = gain, f, at
            if not turn and (feature[open_] >= 0).all():
                break
        split = np.flatnonzero(feature >= 0)
        np.add.at(gains, feature[split], np.maximum(best[split], 0))
        below = np.zeros(nodes, np.int64)
        below[split] = level_start + nodes + 2 * np.arange(len(split))
        for name, data in (("feature", feature), ("cut", cut), ("below", below), ("value", total / count + center)):
            parts[name].append(data.astype(kinds[name]))
        if len(split):
            held = size[split]
            stay = ranges(start[split], held) if len(split) < nodes else np.arange(len(rows))
            right = flat.take(np.repeat(feature[split] * width, held) + rows.take(stay)) > np.repeat(
                cut[split], held)
            size, order = sides(right, held)
            stay = stay.take(order)
            rows, w, wy, y = rows.take(stay), w.take(stay), wy.take(stay), y.take(stay)
        level_start, nodes, level = level_start + nodes, 2 * len(split), level + 1
    return {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, t)
            for k, t in kinds.items()} | {"gain": gains}


def places(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """The features of each node in a random order: the place of each."""
    some = max(1, HELD_ROWS // max(1, features))
    return np.concatenate([
        rng.random((min(some, nodes - begin), features)).argsort(1).argsort(1).astype(np.int16)
        for begin in range(0, nodes, some)])


def sides(right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows per child, left and right in turn, of nodes whose rows follow each other, and the
    places of the rows by child."""
    beyond = np.add.reduceat(right, np.cumsum(size) - size, dtype=np.int64)
    child = np.stack([size - beyond, beyond], 1)
    start = (np.cumsum(child) - child.ravel()).reshape(-1, 2)
    order = np.empty(len(right), np.int64)
    for k, side in enumerate((~right, right)):
        if child[:, k].any():
            order[ranges(start[:, k], child[:, k])] = np.flatnonzero(side)
    return child.ravel(), order


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf value of each column of `x`."""
    at, open_ = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
    while len(open_):
        here = at.take(open_)
        feature = tree["feature"].take(here)
        inner = np.flatnonzero(feature >= 0)
        open_, feature, here = open_.take(inner), feature.take(inner).astype(np.int64), here.take(inner)
        at[open_] = tree["below"].take(here) + (flat.take(feature * width + open_) > tree["cut"].take(here))
    return tree["value"].take(at)


# -- pieces: rows of one node -------------------------------------------------------

@dataclass
class Forest:
    subtrees: DataFrame
    trees: int
    models: int
    splits: dict = field(default_factory=dict)  # (model, tree, node): feature, cut, below, gain

    def importances(self, model: int = 0) -> np.ndarray:
        """The mean over the trees of the share of each feature in the squared error taken away."""
        own = self.subtrees.where(F.col("model") == model)
        total = {r["tree"]: np.frombuffer(r["data"], np.float64).copy() for r in added(
            own.select("tree", F.col("gain").alias("data")), ["tree"]).collect()}  # a row per tree
        for (m, tree, _), (feature, _, _, gain) in self.splits.items():
            if m == model:
                total[tree][feature] += max(gain, 0.0)
        shares = [t / t.sum() for t in total.values() if t.sum() > 0]
        size = len(next(iter(total.values()), []))
        return np.mean(shares, 0) if shares else np.zeros(size)


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def coded_labels(y: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A block's labels as bytes and what these stand for, if they have at most 256 values; else
    as they are."""
    labels, code = np.unique(y, return_inverse=True)
    return (code.astype(np.uint8), labels.tobytes()) if len(labels) <= 256 else (y, b"")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and weights of a piece: rows of one block in one node of one tree."""
    labels = np.frombuffer(row["labels"], np.float64)
    y = labels[np.frombuffer(row["y"], np.uint8)] if len(labels) else np.frombuffer(row["y"], np.float64)
    return np.frombuffer(row["x"], np.uint8).reshape(-1, row["n"]), y, np.frombuffer(row["w"], np.uint8)


def drawn(block: Block, model: int, tree: int, own: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows `own` that a tree draws, and the weights of all rows."""
    w = generator(seed, model, tree, block.id).poisson(1.0, block.n).astype(np.uint8)
    return np.flatnonzero(own & (w > 0)), w


def below_splits(x: np.ndarray, rows: np.ndarray, model: int, tree: int, splits: dict
                 ) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) where the rows `rows` of the bins `x` come to a stop in a tree's large nodes."""
    open_ = [(1, rows)] if len(rows) else []
    while open_:
        node, own = open_.pop()
        split = splits.get((model, tree, node))
        if split is None:
            yield node, own
            continue
        right = x[split[0]].take(own) > split[1]
        open_ += [(split[2] + k, own[side]) for k, side in enumerate((~right, right)) if side.any()]


def tried(key: tuple, features: int, tries: int, seed: int, first: bool) -> list[int]:
    """The features that a large node tries at first, or the others."""
    order = generator(seed, *key, 7).permutation(features)
    return sorted(int(f) for f in (order[:tries] if first else order[tries:]))


def split_large(blocks: DataFrame, large: list, splits: dict, tries: int, seed: int, first: bool = True) -> dict:
    """Best cut of each large node, and the rows on its sides: histograms of the features it
    tries, of weights, weighted labels and rows, summed over the blocks."""
    sums, found_ = (arrow(s) for s in (HISTOGRAM, CHOSEN))
    wanted = set(large)
    trees = sorted({key[:2] for key in wanted})

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        for block in read_blocks(batches):
            for model, tree in trees:
                rows, w = drawn(block, model, tree, block.learned_by(model), seed)
                for node, own in below_splits(block.x, rows, model, tree, splits):
                    key = (model, tree, node)
                    if key not in wanted:
                        continue
                    features = tried(key, len(block.x), tries, seed, first)
                    if not features:
                        continue
                    if key not in total:
                        total[key] = np.zeros((len(features), 3, BINS))
                    weight = w.take(own).astype(float)
                    label = weight * block.y.take(own)
                    for at, f in enumerate(features):
                        column = block.x[f].take(own).astype(np.int64)
                        for k, add in enumerate((weight, label, None)):
                            total[key][at, k] += np.bincount(column, add, BINS)
        for key, data in total.items():
            yield pa.RecordBatch.from_pylist([dict(zip(NODE, key)) | {"data": data.tobytes()}], sums)

    features = blocks.select("x", "n").head()
    features = len(features["x"]) // features["n"] if features else 0

    def choose(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hist = np.frombuffer(row["data"], np.float64).reshape(-1, 3, BINS)
                found = None
                for at, f in enumerate(tried(tuple(row[k] for k in NODE), features, tries, seed, first)):
                    whole = hist[at].sum(1)
                    left = hist[at].cumsum(1)[:, :-1]
                    right = whole[:, None] - left
                    ok = (left[0] > 0.5) & (right[0] > 0.5)
                    if not ok.any():
                        continue
                    safe = np.where(ok, left[0], 1.0), np.where(ok, right[0], 1.0)
                    gain = np.where(ok, left[1] ** 2 / safe[0] + right[1] ** 2 / safe[1]
                                    - whole[1] ** 2 / whole[0], -np.inf)
                    cut = int(gain.argmax())
                    if found is None or gain[cut] > found["gain"] + TIE * abs(gain[cut]):
                        found = {"feature": f, "cut": cut, "gain": float(gain[cut]),
                                 "left_rows": float(left[2, cut]), "right_rows": float(right[2, cut])}
                if found:
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in NODE} | found], found_)

    best = added(blocks.select(*COLUMNS).mapInArrow(partial, HISTOGRAM), NODE).mapInArrow(choose, CHOSEN)
    return {tuple(r[k] for k in NODE): r for r in best.collect()}


def large_splits(blocks: DataFrame, models: int, trees: int, tries: int, seed: int
                 ) -> tuple[dict, dict]:
    """Splits of all nodes of more than SUBTREE_ROWS rows, and of the roots: (model, tree, node):
    feature, cut, below, gain; and the rows of the nodes below. Nodes whose rows don't differ are
    not split."""
    splits, next_node, rows = {}, {(m, t): 2 for m in range(models) for t in range(trees)}, {}
    large = [(m, t, 1) for m in range(models) for t in range(trees)]
    while large:
        found = {}
        for first in (True, False):  # the other features where none of the first cuts a node
            left = [key for key in large if key not in found]
            some = HELD_BYTES // (tries * 3 * BINS * 8)
            for begin in range(0, len(left), some):
                found |= split_large(blocks, left[begin:begin + some], splits, tries, seed, first)
        large = []
        for key in sorted(found):
            r, below = found[key], next_node[key[:2]]
            splits[key] = (r["feature"], r["cut"], below, r["gain"])
            next_node[key[:2]] += 2
            rows |= {(*key[:2], below + k): n for k, n in enumerate((r["left_rows"], r["right_rows"]))}
            large += [(*key[:2], below + k) for k in range(2) if rows[(*key[:2], below + k)] > SUBTREE_ROWS]
    return splits, {key: n for key, n in rows.items() if key not in splits}


def shared_out(rows: dict, tasks: int) -> dict:
    """A task for each node: the largest first, each to the task with the fewest rows so far."""
    held = [(0.0, task) for task in range(tasks)]
    found = {}
    for key in sorted(rows, key=lambda k: (-rows[k], k)):
        n, task = held[0]
        found[key] = task
        heapq.heapreplace(held, (n + rows[key], task))
    return found


def fit_forest(blocks: DataFrame, models: int, trees: int, tries: int, rows: int, seed: int = 42,
               depth: int | None = None) -> Forest:
    """`trees` trees for each model. `rows` is the number of training rows of model 0.

    `tries` features are looked at per node. `depth` bounds the levels of a subtree; None grows
    until nodes are pure or their rows don't differ. All weights and draws follow from the seed
    and from block, model, tree and node, so a task that runs again makes the same trees.
    """
    with few_blocks(blocks.sparkSession):
        splits, below = large_splits(blocks, models, trees, tries, seed) if rows > SUBTREE_ROWS else ({}, {})
        below |= {(m, t, 1): float(rows) for m in range(models) for t in range(trees) if (m, t, 1) not in splits}
        return Forest(_subtrees(blocks, models, trees, tries, seed, depth, splits, below), trees, models, splits)


def _subtrees(blocks: DataFrame, models: int, trees: int, tries: int, seed: int, depth: int | None,
              splits: dict, below: dict) -> DataFrame:
    """The subtrees below all splits, written: each node's rows go to one task. `below` has the
    nodes and their rows; tasks get about as many rows each, and large nodes are begun first."""
    pieces_schema = arrow(PIECE)
    tasks = max(1, min(len(below), 16 * blocks.sparkSession.sparkContext.defaultParallelism))
    task = shared_out(below, tasks)

    def deal(batches):
        for block in read_blocks(batches):
            y, labels = coded_labels(block.y)
            for model in range(models):
                learned = block.learned_by(model)
                for tree in range(trees):
                    use, w = drawn(block, model, tree, learned, seed)
                    made = [{"task": task[model, tree, node], "model": model, "tree": tree, "node": node,
                             "n": len(own), "block": block.id, "x": block.x.take(own, 1).tobytes(),
                             "y": y.take(own).tobytes(), "labels": labels, "w": w.take(own).tobytes()}
                            for node, own in below_splits(block.x, use, model, tree, splits)]
                    if made:
                        yield pa.RecordBatch.from_pylist(made, pieces_schema)

    pieces = blocks.select(*COLUMNS).mapInArrow(deal, PIECE)
    schema = arrow(SUBTREE)

    def finish(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        x, y, w = (np.concatenate([p[k] for p in held], -1) for k in range(3))
        held.clear()
        made = grow(x, y, w, tries, generator(seed, *key, 3), depth)
        return pa.RecordBatch.from_pylist([dict(zip(NODE, key)) | {k: v.tobytes() for k, v in made.items()}
                                           | {"n_nodes": len(made["value"])}], schema)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in NODE)
                if held and own != key:
                    yield finish(key, held)
                key = own
                held.append(unpacked(row))
        if held:
            yield finish(key, held)

    dealt = pieces.repartitionById(tasks, "task").sortWithinPartitions(*NODE, "block")
    return materialise(dealt.drop("task").mapInArrow(run, SUBTREE), "subtrees", "zstd")


# -- scores ---------------------------------------------------------------------------

def score_forest(blocks: DataFrame, forest: Forest, label: str = "scores") -> DataFrame:
    """(model, label, score): rows scored by the model judged on them, written.

    A score is the mean over the trees. Rows go to the subtree they fall in, for every tree; a
    task gets those of one subtree.
    """
    routed = "model int, tree int, node long, block long, n int, at binary, x binary"
    schema, splits, trees, models = arrow(routed), forest.splits, forest.trees, forest.models

    def route(batches):
        for block in read_blocks(batches):
            for model in range(models):
                rows = np.flatnonzero(block.judged_by(model))
                for tree in range(trees):
                    made = [{"model": model, "tree": tree, "node": node, "block": block.id, "n": len(own),
                             "at": own.astype(np.int32).tobytes(), "x": block.x.take(own, 1).tobytes()}
                            for node, own in below_splits(block.x, rows, model, tree, splits)]
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema)

    made = "model int, block long, tree int, at binary, value binary"
    made_schema = arrow(made)

    def value(rows: pa.Table, tree: pa.Table) -> pa.Table:
        if not len(tree):
            if len(rows):
                raise ValueError("rows fall into a subtree that is not there")
            return pa.Table.from_pylist([], made_schema)
        own = tree.to_pylist()[0]
        kinds = {"feature": np.int16, "cut": np.uint8, "below": np.int32, "value": np.float64}
        grown = {k: np.frombuffer(own[k], t) for k, t in kinds.items()}
        held = rows.to_pylist()
        if not held:
            return pa.Table.from_pylist([], made_schema)
        values = walk(grown, np.concatenate([
            np.frombuffer(r["x"], np.uint8).reshape(-1, r["n"]) for r in held], 1))
        ends = np.cumsum([r["n"] for r in held])[:-1]
        return pa.Table.from_pylist([{
            "model": r["model"], "block": r["block"], "tree": r["tree"], "at": r["at"], "value": v.tobytes()}
            for r, v in zip(held, np.split(values, ends))], made_schema)

    pieces = blocks.select(*COLUMNS).mapInArrow(route, routed)
    values = pieces.groupBy(*NODE).cogroup(forest.subtrees.groupBy(*NODE)).applyInArrow(value, made)
    # Blocks' labels meet the trees' values: rows with the labels sort first.
    labels = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model"), "block",
                           F.lit(-1).alias("tree"), F.col("part").alias("at"), F.col("y").alias("value"))

    def add(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["tree"] < 0:
                    if held is not None:
                        yield from mean(*held)
                    part = np.frombuffer(r["at"], np.uint8)
                    held = (r["model"], part, np.frombuffer(r["value"], np.float64), np.zeros(len(part)))
                else:
                    held[3][np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["value"], np.float64)
        if held is not None:
            yield from mean(*held)

    def mean(model, part, y, total):
        own = part == (255 if model == 0 else model - 1)
        if own.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(own.sum(), model), pa.int32()), pa.array(y[own]),
                 pa.array(total[own] / trees)], ["model", "label", "score"])

    with few_blocks(blocks.sparkSession), settings(blocks.sparkSession, FEW_SUBTREES):
        return materialise(values.unionByName(labels).repartition("model", "block").sortWithinPartitions(
            "model", "block", "tree").mapInArrow(add, "model int, label double, score double"), label)

"""Toxicity scores from word pieces: a small classifier trained here.

A word is the bag of its character n-grams and itself, each hashed to an embedding. A short
window of words is the average of its embeddings, and a linear softmax turns that into a
probability. A text scores as its most toxic window, so a slur counts the same in a long text.
Embeddings and softmax are trained together, so a misspelt word inherits from its n-grams.
"""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches, whole_text, written
from .words import code_points, ngram_hashes, span_hashes

# Labelled texts of each class that are fitted at most, taken by their hash, copies once.
FIT_ROWS = 1500
SHORTEST, LONGEST = 3, 5  # characters of an n-gram, with < and > at the ends of the word
BUCKETS, SIZE = 1 << 17, 8
WINDOW = 3
ROUNDS_WHOLE, ROUNDS_WINDOW, RATE, DECAY = 5, 30, 0.05, 1e-4
CHUNK_WORDS = 1 << 14  # words whose buckets are in memory as vectors at a time
KEPT_WORDS = 200_000
EDGES = ".,;:!?\"'()[]{}<>«»“”„…-–—"


def plain_word(chunk: str) -> str:
    return chunk.lower().strip(EDGES)


def split_words(text: str) -> list[str]:
    return [w for w in map(plain_word, text.split()) if w]


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams, one word after another, and their numbers."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    points = code_points("".join(f"<{w}>" for w in words))
    end = np.cumsum(sizes)
    inside = np.repeat(np.arange(len(words)), sizes)
    owners, hashes = [np.arange(len(words))], [span_hashes(points, end - sizes, end)]
    for n in range(SHORTEST, LONGEST + 1):
        grams = ngram_hashes(points.astype(np.uint64) + np.uint64(1), n)
        whole = np.flatnonzero(np.arange(len(grams)) + n <= end[inside[:len(grams)]])
        owners.append(inside[whole])
        hashes.append(grams[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int32)
    return buckets, np.bincount(owner, minlength=len(words))


class Adam:
    def __init__(self, shape: tuple):
        self.mean, self.square = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        self.step = 0

    def update(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient ** 2 - self.square)
        mean = self.mean / (1 - 0.9 ** self.step)
        value -= RATE * mean / (np.sqrt(self.square / (1 - 0.999 ** self.step)) + 1e-8)


class Bags:
    """The texts as word numbers, and the words as buckets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        lengths, words = [], array("i")
        for text in texts:
            own = split_words(text)
            lengths.append(len(own))
            words.extend(number.setdefault(w, len(number)) for w in own)
        listed = list(number)
        parts = [pieces(listed[i:i + CHUNK_WORDS]) for i in range(0, len(listed), CHUNK_WORDS)]
        self.flat = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int32)])
        self.sizes = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        self.words, self.lengths = np.array(words, np.int32), np.array(lengths, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.begin = np.cumsum(self.lengths) - self.lengths

    def distinct_words(self, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word of each text in `full` once, and the number of its text."""
        found = [np.unique(self.words[b:b + n]) for b, n in zip(
            self.begin[full].tolist(), self.lengths[full].tolist())]
        return (np.concatenate(found) if found else self.words,
                np.repeat(np.arange(len(found)), [len(f) for f in found]))

    def refs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words one after another, and where each word's begin."""
        size = self.sizes[words]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.starts[words] - begin, size) + np.arange(size.sum())], begin

    def scores(self, per_bucket: np.ndarray) -> np.ndarray:
        """The sum of each word's buckets."""
        return np.add.reduceat(per_bucket.astype(np.float32)[self.flat], self.starts)

    def sums(self, words: np.ndarray, per_bucket: np.ndarray) -> np.ndarray:
        out = []
        for part in np.split(words, range(CHUNK_WORDS, len(words), CHUNK_WORDS)):
            flat, begin = self.refs(part)
            out.append(np.add.reduceat(per_bucket[flat], begin, axis=0))
        return np.concatenate(out)

    def to_buckets(self, words: np.ndarray, per_word: np.ndarray) -> np.ndarray:
        """The transpose of `sums`."""
        out = np.zeros((BUCKETS, per_word.shape[1]), np.float32)
        for at in range(0, len(words), CHUNK_WORDS):
            part = words[at:at + CHUNK_WORDS]
            flat, _ = self.refs(part)
            owner = np.repeat(np.arange(at, at + len(part)), self.sizes[part])
            out += spread(flat, per_word[owner], BUCKETS)
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def spread(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of `rows` by index."""
    return np.stack([np.bincount(index, rows[:, k], size).astype(np.float32)
                     for k in range(rows.shape[1])], 1)


class Model:
    """Scores texts. What a chunk between white space contributes is kept, for KEPT_WORDS of
    them or those of one text, if more."""

    def __init__(self, bucket_score: np.ndarray, bias: float):
        self.bucket_score, self.bias = bucket_score, bias
        self.forget(KEPT_WORDS)

    def forget(self, room: int) -> None:
        self.number: dict[str, int] = {}
        self.values = np.zeros((room, 2))  # sum and number of the buckets; none without letters

    def learn(self, chunks: set[str]) -> None:
        first = len(self.number)
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.values[first:first + len(chunks)] = 0
        words = {c: w for c in chunks if (w := plain_word(c))}
        if words:
            buckets, sizes = pieces(list(words.values()))
            at = [self.number[c] for c in words]
            self.values[at, 0] = np.add.reduceat(self.bucket_score[buckets],
                                                 np.cumsum(sizes) - sizes, dtype=np.float64)
            self.values[at, 1] = sizes

    def score(self, text: str) -> float:
        chunks = text.split()
        numbers = list(map(self.number.get, chunks))
        if None in numbers:
            new = {c for c, n in zip(chunks, numbers) if n is None}
            if len(self.number) + len(new) > len(self.values):
                new = set(chunks)
                self.forget(max(KEPT_WORDS, len(new)))
            self.learn(new)
            numbers = list(map(self.number.__getitem__, chunks))
        values = self.values[numbers] if numbers else np.zeros((0, 2))
        values = values[values[:, 1] > 0]
        top = window_scores(values).max() if len(values) else 0.0
        return float(1 / (1 + np.exp(-(top + self.bias))))


def window_scores(values: np.ndarray) -> np.ndarray:
    """Mean score of the buckets in each window; a text shorter than a window is one."""
    sums = np.concatenate([[[0.0, 0.0]], np.cumsum(values, 0)])
    wide = min(WINDOW, len(values))
    part = sums[wide:] - sums[:-wide]
    return part[:, 0] / part[:, 1]


def best_windows(bags: Bags, word_score: np.ndarray,
                 full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in the highest window of each text in `full`, and the number of their text."""
    values = np.stack([word_score[bags.words], bags.sizes[bags.words]], 1)
    begin, length = bags.begin[full], bags.lengths[full]
    top = np.array([b + window_scores(values[b:b + n]).argmax()
                    for b, n in zip(begin.tolist(), length.tolist())], np.int64)
    wide = np.minimum(WINDOW, length)
    owner = np.repeat(np.arange(len(full)), wide)
    at = np.repeat(top - np.cumsum(wide) + wide, wide) + np.arange(len(owner))
    return bags.words[at], owner


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Full-batch training with a fixed start, so the same rows give the same model.

    The first rounds average the distinct words of whole texts; the later ones the highest window of each text, so
    that toxic texts teach by their worst words and clean ones by what looks worst in them. An
    empty window is one more clean example. Both classes weigh the same.
    """
    labels = np.array(toxic, np.int64)
    if not len(labels) or labels.min() == labels.max():
        # One class only: its side of the scale for every text.
        return Model(np.zeros(BUCKETS, np.float32), 3.0 if len(labels) and labels[0] else -3.0)
    bags = Bags(texts)
    rng = np.random.Generator(np.random.PCG64(7))
    embedding = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2)
    adams = Adam(embedding.shape), Adam(weights.shape), Adam(bias.shape)
    full = np.flatnonzero(bags.lengths)
    y = np.append(labels[full], 0)  # the last is the empty window
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / (y == 0).sum())
    share[-1] = 0.1
    distinct = bags.distinct_words(full)
    for step in range((ROUNDS_WHOLE + ROUNDS_WINDOW) if len(full) else 0):
        if step < ROUNDS_WHOLE:
            word_of, owner = distinct
        else:
            score = bags.scores(embedding @ (weights[:, 1] - weights[:, 0]))
            word_of, owner = best_windows(bags, score, full)
        words, word = np.unique(word_of, return_inverse=True)
        vectors = bags.sums(words, embedding)
        total = np.bincount(owner, bags.sizes[words][word], len(full))
        mean = spread(owner, vectors[word], len(full)) / total[:, None]
        mean = np.vstack([mean, np.zeros(SIZE)])
        error = (softmax(mean @ weights + bias) - np.eye(2)[y]) * share[:, None]
        to_mean = (error @ weights.T)[:-1] / total[:, None]
        to_word = spread(word, to_mean[owner], len(words))
        to_bucket = bags.to_buckets(words, to_word) + DECAY * embedding / len(y)
        adams[0].update(embedding, to_bucket)
        adams[1].update(weights, mean.T @ error)
        adams[2].update(bias, error.sum(0))
    score = embedding @ (weights[:, 1] - weights[:, 0])
    return Model(score.astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 5; null ids are held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most `fit_rows` different labelled texts of each class that are not held out.

    Texts are chosen by their hash, and of the copies of one in a class the smallest id stands for
    all. Only ids and hashes are joined with the labels, and only the chosen rows' texts come to
    the driver. Null labels
    teach nothing; of several labels for an id the highest counts.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .filter(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).join(known, "id")
    chosen = written(reduce(DataFrame.unionByName, [
        rows.filter(F.col("toxic") == value).groupBy("hash", "toxic").agg(F.min("id").alias("id"))
        .orderBy("hash").limit(fit_rows) for value in (0, 1)]), "fit-rows")  # at most 2 * fit_rows rows
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"),
                        text.alias("text")).join(F.broadcast(chosen), ["id", "hash"])
    texts, toxic = [], []
    for r in found.dropDuplicates(["id", "hash"]).orderBy("hash", "id").toLocalIterator():
        texts.append(r["text"])
        toxic.append(r["toxic"])
    return fit(texts, toxic)


def scorer(model: Model, spark):
    """Arrow function from texts to scores; the model it carries has a fixed size."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.bucket_score, model.bias))
    kept: list[Model] = []

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Model(*shared.value))
        return pa.array([kept[0].score(t) for t in texts.to_pylist()], pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`.

    Whole texts are scored, and nothing but the text enters a score. A null or empty text, or
    one without words, has the score of an empty window. Without labels of both classes every
    score is the same. Rows with a null or repeated id are scored like any other; an empty
    table gives no rows; other columns are not read.
    """
    score = scorer(train(docs, labels, id_col, text_col), docs.sparkSession)
    rows = docs.select(F.col(id_col), whole_text(text_col)).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score 0.5 or more; columns are those of `docs`.

    A null text scores as an empty one; repeated rows score alike, so they stay or go together;
    a row with a null id can't be labelled but is scored. An empty table gives no rows.
    """
    score = scorer(train(docs, labels, id_col, text_col), docs.sparkSession)
    return docs.filter(score(whole_text(text_col)) < 0.5)

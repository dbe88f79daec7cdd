"""How far the sources of a language differ in the terms they use.

Each source's counts over its language's vocabulary are a column. The vocabulary is dealt to
shards; within a shard terms are put in an order that brings equal counts together, and each
column is kept as runs of equal counts. Two columns are compared run by run: their boundaries
are merged, and what a pair of counts adds is multiplied by the length of the common run.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .words import mixed

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
# Terms of a shard, entries counted before they are handed on, and pairs in a batch of results.
SHARD_TERMS, COUNTED, PAIRS_HELD = 4096, 1 << 19, 1 << 16

# Letters and all bytes of what is not ASCII stay, A to Z in lower case; the rest separates.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(lang, source, term, n, n_docs) in parts; a null term marks that a group occurs."""
    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = text.translate(TERM_BYTES).split()
                n, n_docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                n_docs.update(set(own))
                size += len(n)
                if size >= COUNTED:
                    yield from count_batches(held)
                    held, size = {}, 0
        yield from count_batches(held)

    small_batches(docs.sparkSession)
    return docs.select("lang", "source", F.coalesce(F.col(text_col).cast("string"), F.lit(""))
                       .cast("binary").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, n_docs long")


def count_batches(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, n_docs) in held.items():
        terms = [None, *(t.decode("utf-8", "replace") for t in n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(terms)), pa.array([source] * len(terms)),
             pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()),
             pa.array([0, *(n_docs[t] for t in n)], pa.int64())],
            ["lang", "source", "term", "n", "n_docs"])


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exact at any count."""
    wide = [c.cast("decimal(19,0)") for c in (count + 1, total + vocabulary)]
    return F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])


class RunColumn:
    """The runs of one source's counts over the terms of a shard."""

    def __init__(self, place: np.ndarray, count: np.ndarray, terms: int, total: int, vocabulary: int):
        dense = np.zeros(terms, np.int64)
        dense[place] = count
        self.start = np.flatnonzero(np.append(True, dense[1:] != dense[:-1])) if terms else place[:0]
        values, which = np.unique(dense[self.start], return_inverse=True)
        self.share = np.array([1 + SCALE * (c + 1) // (total + vocabulary)
                               for c in values.tolist()], np.int64)[which]

    def against(self, other: "RunColumn", terms: int) -> tuple[int, int]:
        """Sums of floor((p - q)^2 / q), this column's p with the other's q, and the reverse."""
        start = np.union1d(self.start, other.start)
        p = self.share[np.searchsorted(self.start, start, "right") - 1]
        q = other.share[np.searchsorted(other.start, start, "right") - 1]
        length, square = np.diff(np.append(start, terms)), (p - q) ** 2
        return int((square // q * length).sum()), int((square // p * length).sum())


def compare_columns(shard: pa.Table) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of all pairs of sources over one shard of a language.

    Rows without a term list the sources, with their totals; the others are counts.
    """
    lang = shard.column("lang")[0].as_py()
    listed = shard.column("term").is_null().to_numpy()
    names = shard.column("source").to_numpy()
    sources, group = np.unique(names, return_inverse=True)
    total = np.zeros(len(sources), np.int64)
    total[group[listed]] = shard.column("total").to_numpy()[listed]
    vocabulary = shard.column("vocabulary").to_numpy()[listed]
    group, count = group[~listed], shard.column("n").to_numpy()[~listed].astype(np.int64)
    terms, term = np.unique(shard.column("term").to_numpy()[~listed], return_inverse=True)
    # Terms with the same counts in every source have the same sum of hashes.
    alike, all_counts = np.zeros(len(terms), np.uint64), np.zeros(len(terms), np.int64)
    np.add.at(alike, term, mixed(mixed(count.astype(np.uint64)) + group.astype(np.uint64)))
    np.add.at(all_counts, term, count)
    place = np.empty(len(terms), np.int64)
    place[np.lexsort((alike, all_counts))] = np.arange(len(terms))
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(1, len(sources)))
    columns = [RunColumn(place[term[own]], count[own], len(terms), int(t), int(vocabulary[0]))
               for own, t in zip(np.split(order, cuts), total)]
    out: list[tuple[str, str, int]] = []
    for a, one in enumerate(columns):
        for b in range(a + 1, len(columns)):
            there, back = one.against(columns[b], len(terms)) if len(terms) else (0, 0)
            out += [(sources[a], sources[b], there), (sources[b], sources[a], back)]
        if len(out) >= PAIRS_HELD or (out and a == len(columns) - 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(out)), *(pa.array(x) for x in zip(*out))],
                ["lang", "source", "item", "value"])
            out = []


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                       F.row_number().over(order).alias("rank"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ.

    Terms are runs of letters and of anything beyond ASCII, A to Z lower-cased; a language keeps
    those in at least three of its documents. A term's share p in a group is
    1 + floor(10^9 (count + 1) / (all + terms)); floor((p - q)^2 / q) weighs it against the share
    q. Part `pair` has that sum against each other source of the language, part `term` the 200
    terms that stand out most against the language. Null language, source or text is empty text;
    repeated rows count again; groups without terms are compared, too; an empty table gives no
    rows; other columns are not read.
    """
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
                       F.col(text_col))
    counted = written(term_counts(rows, text_col).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "term-counts")
    kept = written(counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
        .filter(F.col("n_docs") >= LEAST_DOCUMENTS).drop("n_docs"), "kept-terms")
    cells = written(counted.filter("term IS NOT NULL").drop("n_docs").join(kept, ["lang", "term"]),
                    "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"),
                                     F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = written(
        counted.filter("term IS NULL").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c)
                                    for c in ("total", "vocabulary", "lang_total")])
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(
            F.col("vocabulary") / F.lit(SHARD_TERMS)).cast("int"))), "groups")

    # Every shard of a language lists all its sources, also those that use none of its terms.
    listed = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                           "source", F.lit(None).cast("string").alias("term"),
                           zero.alias("n"), "total", "vocabulary")
    shards = groups.select("lang", "shards").distinct()
    dealt = cells.join(shards, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source",
        "term", "n", zero.alias("total"), zero.alias("vocabulary"))
    pairs = listed.unionByName(dealt).groupBy("lang", "shard").applyInArrow(
        lambda shard: pa.Table.from_batches(compare_columns(shard), RESULT),
        "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    standing = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(
        F.col("p") > F.col("q")).select(
        "lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = ranked(standing, "term").filter(F.col("rank") <= TOP_TERMS)
    return ranked(pairs, "pair").unionByName(terms)


RESULT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()),
                    ("value", pa.int64())])

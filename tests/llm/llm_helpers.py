"""Rows, and a way to make tables of them, that the tests of this folder share."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Spark's Python workers import the operators, too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """(doc_id, text) rows, in several partitions, with columns whose names may clash."""
    def build(rows, parts: int = 3):
        df = spark.createDataFrame(
            [(d, t, "x", i, None) for i, (d, t) in enumerate(rows)],
            "doc_id long, text string, row string, shard int, n_lines string")
        return df.repartition(parts) if parts else df
    return build


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"),
         (5, "word " * 30_000), (6, "x" * 100_000), (7, "Ünïcödé 😀 \x00 text")]

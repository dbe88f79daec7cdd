from __future__ import annotations

import random

import duckdb
import pytest
from llm_helpers import DATA

import __spark_entry__ as registered
import corpus_pipeline
from tallymark.llm import queries
from tallymark.llm.queries import table

TABLES = ["documents", "pages", "labels", "benchmark"]


def test_all_are_registered():
    names = set(registered.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_spelling_variants",
                                                               "op13_source_divergence"}))
def test_one_row_for_each_input_row(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    key = "page_id" if "page_id" in rows.columns else "doc_id"
    source = table(spark, DATA, "pages" if key == "page_id" else "documents")
    got = [r[0] for r in rows.select(key).collect()]
    want = [r[0] for r in source.select(key).collect()]
    if name.startswith("op9_"):
        assert got and set(got) <= set(want)
    elif name.startswith("op1_"):
        assert set(got) == set(want)
    else:
        assert sorted(got) == sorted(want)


def test_no_python_in_url_verdicts(spark):
    plan = queries.op3_url_filters(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def planted(spark):
    """Some documents beside the given ones: clean, near copies, and a benchmark passage."""
    rng = random.Random(1)
    words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{i}" for i in range(400)]

    def prose():
        return [rng.choice(words) for _ in range(120)]

    item = table(spark, DATA, "benchmark").filter("item_id = 2").first()["text"]
    copy = prose()
    rows = [(9001, " ".join(prose())), (9002, " ".join(copy)), (9003, " ".join(copy[:-2] + ["x"])),
            (9004, " ".join(copy)), (9005, " ".join([*prose(), *item.split(), *prose()]))]
    return [(i, t, "en", "planted", len(t)) for i, t in rows]


def test_stages(spark, tmp_path):
    """Each stage keeps what it should of its own input, and the columns of documents."""
    docs = table(spark, DATA, "documents")
    docs = docs.unionByName(spark.createDataFrame(planted(spark), docs.schema))
    left = [docs.select("doc_id").toPandas()["doc_id"].tolist()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.filter("n_chars != length(text)").count() == 0
        left.append(docs.select("doc_id").toPandas()["doc_id"].tolist())
    toxic, lines, near, clean = ([set(before) - set(after) for before, after in zip(left, left[1:])])
    assert len(toxic) > 10 and not lines and 9003 in near and 9005 in clean
    assert 9004 in near  # a copy, line by line, so nothing is left of it; one empty text stays
    assert docs.filter("text = ''").count() <= 1
    assert {9001, 9002} <= set(left[-1]) and len(left[-1]) > 0.6 * len(left[0])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r[0] for r in packed.filter("piece = 0").select("doc_id").collect()) == \
        sorted(left[-1])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and very long texts, and no rows at all."""
    schema = table(spark, DATA, "documents").schema
    odd = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, None, "en", "a", 0),
           (2, "", None, "b", 0), (3, "one line of text here\n" * 2, "en", None, None),
           (3, "one line of text here\n" * 2, "en", None, None), (None, "no id but some words", "de", "c", 20),
           (4, "word " * 50_000, "en", "d", 250_000), (5, "some words of its own, in one line", "fr", "e", 34)]
    for number, rows in enumerate((odd, [])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "best-fit packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(str(tmp_path / f"{number}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{number}-{name}"))
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= {r[0] for r in rows} and (not rows or {4, 5} <= left)

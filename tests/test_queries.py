"""Every registered query against its SQL, and the plans of the hot ones."""

from __future__ import annotations

import inspect
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from conftest import DATA
from tallymark import session
from tallymark.operators import ordered
from tallymark.plans import models
from tallymark.sources.star import raw_sales, sales

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
TEXTS = {*registered.llm_queries.QUERIES, "pipeline"} if registered.llm_queries else set()
QUERIES = {n: q for n, q in registered.queries().items() if n not in TEXTS}
ORACLES = {n: q for n, q in registered.oracle_sql().items() if n not in TEXTS}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(plain(r[i]) for i in order) for r in data))


def test_registered_models_are_fitted_whole(spark, monkeypatch):
    for make, name in ((registered.return_models, "ReturnModels"),
                       (registered.revenue_models, "RevenueModels")):
        signature = inspect.signature(getattr(models, name))
        monkeypatch.setattr(models, name, signature.bind)
        given = make(spark, DATA)
        given.apply_defaults()
        assert given.arguments["trees"] == 100 and given.arguments["forest_depth"] is None
        assert given.arguments.get("folds", 5) == 5 and given.arguments["names"] is None


def test_every_query_has_sql():
    """But for what the fitted models give; test_models.py compares that with brute force."""
    assert set(QUERIES) - set(registered.model_results()) == set(ORACLES)


def test_shuffles_follow_the_size_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1000)
    QUERIES["by_region"](spark, DATA)
    size = sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("lineitem", "orders"))
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(spark.conf.get(key)) == -(-size // 1000)
    spark.conf.unset(key)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())
    if name in ("clf_leaderboard", "reg_leaderboard", "topk_importance"):
        return  # tables of a few rows from the driver
    for word in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert word not in plan(df)


def test_entry(spark):
    assert registered.entry(spark).count() == 5


def scans(df):
    text = df._jdf.queryExecution().toString()
    found = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    return " ".join(found)


def test_only_needed_tables_and_columns_are_read(spark):
    read = scans(sales(spark, DATA, "Product", "TotalPrice").groupBy("Product").agg(
        F.sum("TotalPrice")))
    assert "p_type" in read and "l_extendedprice" in read
    for other in ("o_orderkey", "c_custkey", "s_name", "l_tax", "p_name", "l_shipdate"):
        assert other not in read
    assert "o_orderkey" not in scans(sales(spark, DATA, "TotalPrice", "NetRevenue"))


def test_filter_reaches_the_scan(spark):
    text = plan(raw_sales(spark, DATA, "Discount", "TotalPrice").where("Discount > 0.05"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_discount,0.05\)", text)


def test_no_sale_is_lost(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert sales(spark, DATA).count() == lines


def test_large_joins_are_not_forced_to_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(sales(spark, DATA))
        got = ordered.exact_median(sales(spark, DATA, "Region", "DeliveryDays"), "DeliveryDays",
                                   ["Region"])
        assert "BroadcastHashJoin" not in plan(got) and got.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A star schema in which one order holds a third of all lines."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    i = F.col("id")
    n = 60_000
    spark.range(n).select(
        F.when(i % 3 == 0, 7).otherwise(i % 5000).cast("bigint").alias("l_orderkey"),
        (i % 50).alias("l_partkey"), (i % 40).alias("l_suppkey"),
        (1.0 + i % 7).alias("l_quantity"), (100.0 + i % 991).alias("l_extendedprice"),
        ((i % 11) / 100).alias("l_discount"), F.lit(0.05).alias("l_tax"),
        F.when(i % 4 == 0, "R").otherwise("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        .alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(5000).select(
        i.alias("o_orderkey"), (i % 300).alias("o_custkey"),
        F.make_timestamp_ntz(2020 + i % 4, 1 + i % 12, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        .alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")
    ).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("distinct", [False, True])
def test_hot_join_key_is_split(spark, skewed, distinct):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = sales(spark, skewed, "OrderID", "Year", "TotalPrice")
        measure = F.countDistinct("OrderID") if distinct else F.count("OrderID")
        out = df.groupBy("Year").agg(measure.alias("n"), F.sum("TotalPrice"))
        got = sum(r["n"] for r in out.collect())
        assert got == (5000 if distinct else 60_000)
        assert "skew=true" in plan(out)
    finally:
        for key in settings:
            spark.conf.unset(key)

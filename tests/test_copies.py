"""Exact sums, rejected rows, published versions, differences between copies, kept sketches."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallymark.functions.numeric import mean, total
from tallymark.operators import checks, multiset, sketches
from tallymark.operators.clean import clean
from tallymark.plans import report
from tallymark.schema import raw_schema
from tallymark.session import new_path
from tallymark.sources import files, versions


# -- sums of money ---------------------------------------------------------------

def test_totals_have_the_same_bits_in_any_order(spark):
    rng = random.Random(1)
    cents = [rng.randrange(-10 ** 9, 10 ** 9) for _ in range(4000)]
    want = sum(cents) / 10 ** 4
    for parts in (1, 3, 17):
        rng.shuffle(cents)
        df = spark.createDataFrame([(c / 10 ** 4,) for c in cents], "x double").repartition(parts)
        assert df.agg(total(F.col("x"))).first()[0] == want
        assert df.agg(mean(F.col("x"))).first()[0] == want / len(cents)


def test_totals_of_odd_values(spark):
    df = spark.createDataFrame([(1, 0.1), (1, None), (1, float("nan")), (1, 0.2), (2, None), (3, -0.0000004),
                                (4, -1.25), (4, 1e15 + 0.5)], "k int, x double")
    got = {r["k"]: (r["t"], r["m"]) for r in df.groupBy("k").agg(
        total(F.col("x")).alias("t"), mean(F.col("x")).alias("m")).collect()}
    assert got[1] == (0.3, 0.15) and got[2] == (0.0, None) and got[3][0] == 0
    assert got[4][0] == 1e15 - 0.75
    empty = df.limit(0).agg(total(F.col("x")).alias("t"), mean(F.col("x")).alias("m")).first()
    assert tuple(empty) == (0.0, None)


def test_values_with_more_digits_are_counted(spark):
    df = spark.createDataFrame([(1.25, 1 / 3), (99999.123456, 2.0), (None, None)], "a double, b double")
    assert rows(checks.money_scale(df, ["a", "b"]), "column") == [("a", 2, 0), ("b", 2, 1)]


# -- rejected rows ----------------------------------------------------------------

def as_text(df):
    return df.select(*[F.col(f.name).cast("string").alias(f.name) for f in raw_schema().fields])


def test_rows_in_are_rows_out(spark, orders, tmp_path):
    text = as_text(orders([{"OrderID": f"O{i}"} for i in range(6)]))
    plant = {"O1": ("OrderDate", "2024-02-30"), "O2": ("Returned", "yes"), "O3": ("Returned", "7"),
             "O4": ("UnitPrice", "NA"), "O5": ("Date", "")}
    for order, (column, value) in plant.items():
        text = text.withColumn(column, F.when(F.col("OrderID") == order, value).otherwise(F.col(column)))
    text = text.withColumn("Quantity", F.when(F.col("OrderID") == "O3", "two").otherwise(F.col("Quantity")))
    files.write_judged(text.withColumn("extra", F.lit(1)), str(tmp_path / "sides"))
    good, bad = (read(spark, str(tmp_path / "sides")) for read in (files.read_accepted, files.read_rejected))
    assert good.count() + bad.count() == 6 and good.schema == raw_schema()
    assert [r[0] for r in rows(good.select("OrderID"), "OrderID")] == ["O0", "O4", "O5"]
    assert good.where("OrderID = 'O4'").first()["UnitPrice"] is None
    assert good.where("OrderID = 'O5'").first()["Date"] is None
    found = {r["OrderID"]: sorted(map(tuple, r["problems"])) for r in bad.collect()}
    assert found == {"O1": [("OrderDate", "2024-02-30", "not a timestamp_ntz")],
                     "O2": [("Returned", "yes", "not a int")],
                     "O3": [("Quantity", "two", "not a int"), ("Returned", "7", "not 0 or 1")]}
    assert bad.where("OrderID = 'O1'").first()["Quantity"] == "2"  # the text is kept
    files.write_judged(text.limit(0), str(tmp_path / "none"))
    assert files.read_accepted(spark, str(tmp_path / "none")).count() == 0


# -- versions ------------------------------------------------------------------------

def test_a_failed_version_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "published")
    with pytest.raises(Exception):
        versions.current(spark, path)

    def table(value):
        def write(folder):
            spark.createDataFrame([(value,)], "x int").write.parquet(folder)
            return {"value": value}
        return write

    def broken(folder):
        table(2)(folder)
        raise RuntimeError("killed half-way")

    first = versions.publish(spark, path, table(1))
    with pytest.raises(RuntimeError):
        versions.publish(spark, path, broken)
    assert versions.current(spark, path) == {"version": first, "value": 1}
    second = versions.publish(spark, path, table(3))
    about = versions.current(spark, path)
    assert about == {"version": second, "value": 3}
    assert spark.read.parquet(f"{path}/{about['version']}").first()[0] == 3
    assert json.load(open(f"{path}/{versions.MANIFEST}")) == about
    assert len([n for n in os.listdir(path) if n.startswith("version-") and n.endswith(".json")]) == 0


def test_published_tables_come_back_whole(spark):
    path = new_path(spark, "published")
    made = {"a": spark.createDataFrame([(2, None, 0.1 + 0.2, True), (1, "x|y", None, None)],
                                       "n int, s string, d double, b boolean"),
            "b": spark.sql("SELECT DATE'2024-02-29' AS day, 12345678901234 AS big, CAST(1.50 AS DECIMAL(9,2)) AS m"),
            "none": spark.createDataFrame([], "x int")}
    assert report.publish_tables(made, path, spark) == ["a", "b", "none"]
    read = report.read_report(spark, path)
    for name, table in made.items():
        assert read[name].schema.simpleString() == table.schema.simpleString()
        assert read[name].collect() == table.collect()  # in their order


# -- differences between copies -------------------------------------------------------

@pytest.fixture
def copies(orders):
    return clean(orders([{"OrderID": f"O{i}", "Quantity": 1 + i % 5, "Region": f"R{i % 3}"}
                         for i in range(60)]))


def test_equal_copies_have_no_differences(spark, copies):
    again = copies.repartition(5).select(*reversed(copies.columns))
    assert multiset.differences(copies, again).count() == 0
    twice = copies.unionByName(copies)
    assert multiset.differences(twice, twice.repartition(3)).count() == 0


def test_one_changed_and_two_swapped_cells_are_found(spark, copies):
    changed = copies.withColumn("Quantity", F.when(F.col("OrderID") == "O7", 99).otherwise(F.col("Quantity")))
    assert rows(multiset.differences(copies, changed)) == [("O7", "Quantity", 1, 1)]
    swap = {"O1": "R2", "O2": "R1"}  # the column's values stay the same as a whole
    swapped = copies.withColumn("Region", F.coalesce(
        *[F.when(F.col("OrderID") == k, v) for k, v in swap.items()], F.col("Region")))
    assert rows(multiset.differences(copies, swapped), "OrderID") == [
        ("O1", "Region", 1, 1), ("O2", "Region", 1, 1)]
    nulled = copies.withColumn("Region", F.when(F.col("OrderID") != "O3", F.col("Region")))
    assert rows(multiset.differences(copies, nulled)) == [("O3", "Region", 1, 1)]


def test_missing_and_doubled_rows_are_found(spark, copies):
    fewer = copies.where("OrderID <> 'O9'")
    found = multiset.differences(copies, fewer)
    assert {tuple(r)[0] for r in found.select("OrderID").collect()} == {"O9"}
    assert rows(found.select("left_rows", "right_rows").distinct()) == [(1, 0)]
    more = copies.unionByName(copies.where("OrderID = 'O4'"))
    assert rows(multiset.differences(copies, more).select("OrderID", "left_rows", "right_rows").distinct()) == [
        ("O4", 1, 2)]


# -- sketches ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def priced(spark):
    i = F.col("id")
    return spark.range(60_000).select(
        F.concat(F.lit("O"), i % 7001).alias("OrderID"), F.concat(F.lit("R"), i % 3).alias("Region"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")).alias("Date"),
        (F.pmod(F.xxhash64(i), F.lit(100_003)) / 7).alias("TotalPrice"))


def within(df, found, region):
    prices = sorted(r[0] for r in df.where(F.col("Region") == region).select("TotalPrice").collect())
    for p, q in zip((0.1, 0.5, 0.99), found["quantiles"]):
        rank = sum(x <= q for x in prices) / len(prices)
        assert abs(rank - p) <= sketches.rank_error() + 1 / len(prices)
    orders = df.where(F.col("Region") == region).select("OrderID").distinct().count()
    assert abs(found["distinct_keys"] - orders) <= sketches.count_error() * orders
    assert found["lines"] == len(prices)


def test_sketches_of_any_period_keep_their_bounds(spark, priced, tmp_path):
    sketches.daily_sketches(priced, ["Region"]).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    points = [0.1, 0.5, 0.99]
    for r in sketches.sketched(sketches.merged(kept, ["Region"]), points).collect():
        within(priced, r, r["Region"])
    part = priced.where("Date BETWEEN DATE'2024-01-10' AND DATE'2024-02-03'")
    for r in sketches.sketched(sketches.merged(kept, ["Region"], "2024-01-10", "2024-02-03"), points).collect():
        within(part, r, r["Region"])
    whole = sketches.sketched(sketches.merged(kept), points).first()
    assert whole["lines"] == 60_000 and abs(whole["distinct_keys"] - 7001) <= 7001 * sketches.count_error()


def test_merged_sketches_of_few_values_are_exact(spark):
    rows_ = [("O1", "2024-01-01", 1.0), ("O2", "2024-01-02", 2.0), ("O2", "2024-01-03", None),
             ("O3", "2024-01-03", float("nan")), ("O4", None, 3.0)]
    df = spark.createDataFrame(rows_, "OrderID string, Date string, TotalPrice double").withColumn(
        "Date", F.to_date("Date"))
    kept = sketches.daily_sketches(df, [])
    got = sketches.sketched(sketches.merged(kept), [0.0, 0.5, 1.0]).first()
    assert (got["quantiles"], got["distinct_keys"], got["lines"]) == ([1.0, 2.0, 3.0], 4, 5)
    none = sketches.sketched(sketches.merged(kept, [], "2024-01-03", "2024-01-03"), [0.5]).first()
    assert none["quantiles"] is None and none["lines"] == 2


# -- written copies and small tasks ---------------------------------------------------

@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_written_copy_is_small_and_whole(spark, orders, tmp_path, fmt):
    """CSV used to be plain text; Parquet rows used to be shuffled once more to be written."""
    from tallymark.session import settings
    raw = orders([{"Date": dt.datetime(2020 + i % 3, 2, 1 + i % 20), "Promotion": "A, \"b\""} for i in range(60)])
    source = clean(raw).repartition(2)
    path = str(tmp_path / fmt)
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        files.write_clean(source, path, fmt)
    parts = [p.name for p in (tmp_path / fmt).rglob("part-*")]
    if fmt == "csv":
        assert parts and all(p.endswith(".csv.gz") for p in parts)
    else:  # a file per task and year
        assert len(parts) == 2 * 3 and {p.name for p in (tmp_path / fmt).glob("Year=*")} == {
            "Year=2020", "Year=2021", "Year=2022"}
    again = (files.read_clean_csv if fmt == "csv" else files.read_clean_parquet)(spark, path)
    names = again.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, source.select(*names).collect()))


def test_settings_hold_inside_only(spark):
    from tallymark.session import settings
    key, unset = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.tallymark.not.there"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), settings(spark, {key: "3MB", unset: "1"}):
        assert spark.conf.get(key) == "3MB" and spark.conf.get(unset) == "1"
        raise KeyError
    assert spark.conf.get(key) == before and spark.conf.get(unset, None) is None


def test_lower_levels_of_an_area_run_in_small_tasks(spark, monkeypatch):
    """They used to run in tasks that grow with the input, up to the advisory size."""
    from tallymark.operators import ordered
    seen, real = [], ordered.materialise

    def watched(df, label):
        seen.append((label, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")))
        return real(df, label)

    monkeypatch.setattr(ordered, "materialise", watched)
    rows = [(i % 7 / 10 + i * 1e-9, int(i % 3 == 0), "a" if i % 2 else "b") for i in range(300)]
    got = ordered.area_under_curve(spark.createDataFrame(rows, "s double, y int, g string"), "s",
                                   F.col("y") == 1, ["g"]).collect()
    assert seen == [("pairs", "8MB")]
    for r in got:
        own = [(s, y) for s, y, g in rows if g == r["g"]]
        pairs = [(p > q) + (p == q) / 2 for p, a in own for q, b in own if a and not b]
        assert r["auc"] == pytest.approx(sum(pairs) / len(pairs))

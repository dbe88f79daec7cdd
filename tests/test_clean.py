import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import derive
from tallymark.functions.numeric import as_percent
from tallymark.operators import clean
from tallymark.schema import CLEAN_COLUMNS, clean_schema
from tallymark.sources import files
from tallymark.operators.checks import compare_copies

from conftest import rows


def test_null_tokens(spark):
    df = spark.createDataFrame([("None",), ("",), ("NA",), ("No Promotion",)], "p string")
    out = clean.normalise_nulls(df, ["p"]).select(derive.fill_promotion(F.col("p")))
    assert [r[0] for r in out.collect()] == ["None", "No Promotion", "No Promotion",
                                             "No Promotion"]


def test_discount_bucket_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.10,), (0.15,), (-0.01,), (None,),
                                (float("nan"),)], "d double")
    out = [r[0] for r in df.select(derive.discount_bucket(F.col("d"))).collect()]
    assert out == ["No Discount", "Low (1–5%)", "Mid (6–10%)", "High (11–15%)", "Low (1–5%)",
                   "High (11–15%)", "High (11–15%)"]


def test_whole_days_floor(spark):
    pairs = [(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 12), -1),
             (dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 2, 4), 0),
             (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 11), 10),
             (dt.datetime(2024, 1, 2, 6), dt.datetime(2024, 1, 1, 6), -1),
             (dt.datetime(2024, 1, 3, 7), dt.datetime(2024, 1, 1, 6), -3),
             (dt.datetime(2024, 3, 30, 12), dt.datetime(2024, 4, 2, 12), 3)]
    df = spark.createDataFrame([p for p in pairs], "s timestamp_ntz, e timestamp_ntz, x int")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = df.select(derive.whole_days(F.col("s"), F.col("e")), "x").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(r[0] == r[1] for r in got), got


def test_rounding(spark):
    one = spark.range(1).select(
        F.bround(F.lit(0.125), 2), F.round(F.lit(0.125), 2), as_percent(F.lit(0.248)),
        as_percent(F.lit(0.248), twice=True)).first()
    assert [float(v) for v in one] == [0.12, 0.13, 24.8, 25.0]


def test_labels(spark):
    one = spark.range(1).select(
        derive.currency(F.lit(1234567.6)), derive.percent(F.lit(24.84)),
        derive.percent(F.lit(0.26), True), derive.month_label(F.lit("2024-03-01").cast("date")),
        derive.squeeze(F.lit("  a \n  b  "))).first()
    assert tuple(one) == ("$1,234,568", "24.8%", "+0.3%", "Mar 2024", "a b")


def test_clean_adds_nine_columns_and_drops_copies(orders):
    raw = orders([{"OrderID": "A", "Discount": 0.1, "Returned": 1}, {"OrderID": "A",
                 "Discount": 0.1, "Returned": 1}, {"OrderID": "B", "Promotion": "SAVE10"}])
    out = clean.clean(raw)
    assert sorted(out.columns) == sorted(CLEAN_COLUMNS)
    got = {r["OrderID"]: r for r in out.collect()}
    assert len(got) == 2 and out.count() == 2
    a = got["A"]
    assert a["Promotion"] == "No Promotion" and a["NetRevenue"] == 0 and a["GrossProfit"] == -5
    assert (a["DeliveryDays"], a["Year"], a["Quarter"], a["YearMonth"]) == (5, 2024, 1, "2024-01")
    assert a["CalcRevenue"] == pytest.approx(180)


def test_duplicates_and_keys(orders):
    df = orders([{"OrderID": "A"}, {"OrderID": "A"}, {"OrderID": "A", "Region": None},
                 {"OrderID": None}])
    assert tuple(clean.duplicate_rows(df).first()) == (4, 3, 1)
    assert tuple(clean.key_uniqueness(df, "OrderID").first()) == (4, 1, 1, 3, False)
    assert clean.key_uniqueness(orders([{}, {}]), "OrderID").first()["is_unique"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, orders, tmp_path, fmt):
    source = clean.clean(orders([
        {"Region": f"R{i % 3}", "Discount": 0.05, "UnitPrice": 10.1 + i,
         "Date": dt.datetime(2023 + i % 2, 1 + i % 12, 3)} for i in range(40)]))
    path = str(tmp_path / "clean")
    files.write_clean(source, path, fmt)
    files.write_clean(source, path, fmt)  # overwrites
    read = files.read_clean_csv if fmt == "csv" else files.read_clean_parquet
    copy = read(spark, path)
    assert copy.columns == clean_schema().fieldNames() or fmt == "parquet"
    result = compare_copies(source, copy, ["Region", "Product", "Promotion"])
    assert {r["status"] for r in result.collect()} == {"OK"}
    assert rows(source.select("OrderID", "Date", "TotalPrice", "DiscountBucket"), "OrderID") == \
        rows(copy.select("OrderID", "Date", "TotalPrice", "DiscountBucket"), "OrderID")


def test_round_trip_notices_a_lost_category(spark, orders):
    source = clean.clean(orders([{}, {"Promotion": "SAVE10"}]))
    broken = source.withColumn("Promotion", F.when(F.col("Promotion") != "No Promotion",
                                                   F.col("Promotion")))
    got = {r["item"]: r["status"] for r in compare_copies(source, broken, ["Promotion"]).collect()}
    assert got["promotion_nulls"] == "MISMATCH" and got["total_by_Promotion"] == "MISMATCH"
    assert got["rows"] == "OK"


def test_csv_bad_value_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("OrderID,Quantity\n1,NA\n2,x\n")
    schema = T.StructType.fromDDL("OrderID string, Quantity int")
    df = files.read_csv(spark, str(path), schema)
    assert df.where("OrderID = '1'").first()["Quantity"] is None
    with pytest.raises(Exception):
        df.collect()


def test_hashed_duplicates_are_the_whole_row_duplicates(orders):
    some = {"OrderID": "A", "Region": None, "Discount": 0.0, "TotalPrice": 7.0}
    df = orders([some, {**some, "Discount": -0.0}, {**some, "Region": ""}, {**some, "Region": "North", "Product": None},
                 {**some, "Product": "North"}, {**some, "OrderID": None}, {**some, "OrderID": None},
                 {**some, "TotalPrice": None}, {**some, "Discount": None}])
    got, want = rows(clean.drop_hashed_duplicates(df)), rows(clean.drop_duplicate_rows(df))
    assert len(got) == len(want) == 7
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_columns_that_nothing_reads_are_not_shuffled(orders):
    """Removing duplicates used to shuffle whole rows."""
    out = clean.clean(orders([{}, {}])).groupBy("Promotion").agg(F.sum("CalcRevenue"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "Aggregate" in line][-1].split("], [")[-1]
    assert "max(UnitPrice" in kept and "Salesperson" not in kept and "OrderID" not in kept

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.functions.derive import fill_promotion
from tallymark.operators import breakdown as bd
from tallymark.operators import crosstab, periods, profile, stats
from tallymark.operators.clean import add_derived
from tallymark.plans import kpi, notes, report

from conftest import rows


def at(y, m, d=10):
    return dt.datetime(y, m, d)


@pytest.fixture
def small(orders):
    return orders([{"Region": "a", "TotalPrice": 1.0}, {"Region": None, "TotalPrice": 2.0},
                   {"Region": "a", "TotalPrice": 3.0}])


def test_null_group_kept_or_dropped(small):
    kept = rows(bd.breakdown(small, ["Region"], ["orders", "gross_revenue"]))
    assert kept == [("a", 2, 4.0), (None, 1, 2.0)]
    dropped = bd.breakdown(small, ["Region"], ["gross_revenue"], drop_null_keys=True)
    assert rows(dropped) == [("a", 4.0)]


def test_sort_ties_and_direction(orders):
    df = orders([{"Product": p, "TotalPrice": v} for p, v in
                 (("b", 5.0), ("a", 5.0), ("c", 9.0))])
    down = bd.breakdown(df, ["Product"], ["gross_revenue"], "gross_revenue")
    assert [r[0] for r in down.collect()] == ["c", "a", "b"]
    up = bd.breakdown(df, ["Product"], ["gross_revenue"], "gross_revenue", descending=False)
    assert [r[0] for r in up.collect()] == ["a", "b", "c"]


def test_rates_rounded_once_or_twice(orders):
    df = orders([{"Returned": int(i < 31)} for i in range(125)])
    assert bd.breakdown(df, ["Region"], ["return_rate"]).first()[1] == 24.8
    assert bd.breakdown(df, ["Region"], ["return_rate"], round_twice=True).first()[1] == 25.0


def test_shares_and_overall(orders):
    df = orders([{"Product": p, "TotalPrice": v, "Returned": r} for p, v, r in
                 (("a", 10.0, 1), ("a", 30.0, 0), ("b", 60.0, 0), ("b", 0.0, 0))])
    share = {r["Product"]: r["share_pct"] for r in bd.share_of_total(df, ["Product"]).collect()}
    assert share == {"a": 40.0, "b": 60.0}
    got = {r["Product"]: (r["rate"], r["overall"], r["difference"], r["at_or_below"])
           for r in bd.rate_vs_overall(df, "Product").collect()}
    assert got == {"a": (50.0, 25.0, 25.0, False), "b": (0.0, 25.0, -25.0, True)}


def test_spread_breaks_ties_by_name(orders):
    df = orders([{"Product": p, "TotalPrice": 5.0, "Returned": 1} for p in ("b", "a")])
    one = bd.group_spread(df, ["Product"]).first()
    assert one["highest_rate_level"] == "a" and one["lowest_rate_level"] == "a"
    assert one["revenue_gap"] == 0 and one["levels"] == 2


def test_level_totals_keep_null_levels_apart(small):
    got = {(r["dim"], r["level"]): r["revenue"]
           for r in bd.level_totals(small, ["Region", "Product"]).collect()}
    assert got == {("Region", "a"): 4.0, ("Region", None): 2.0, ("Product", "Desk"): 6.0}


def test_every_discount_tier_is_listed(orders):
    df = add_derived(orders([{"Discount": 0.0}, {"Discount": 0.1}]))
    got = [(r["bucket"], r["lines"]) for r in bd.discount_tiers(df).orderBy("position").collect()]
    assert got == [("No Discount", 1), ("Low (1–5%)", None), ("Mid (6–10%)", 1),
                   ("High (11–15%)", None)]


def test_undiscounted_promotions(orders):
    df = orders([{"Promotion": "A", "Discount": 0.0}, {"Promotion": "A", "Discount": 0.1},
                 {"Promotion": "B", "Discount": 0.2}, {"Discount": 0.0}])
    df = df.withColumn("Promotion", fill_promotion(F.col("Promotion")))
    got = {r["promotion"]: (r["lines"], r["undiscounted"])
           for r in bd.undiscounted_promotions(df).collect()}
    assert got == {"A": (2, 1), "B": (1, 0), "(all)": (3, 1)}


def test_month_gap(orders):
    df = orders([{"Date": at(2024, 1), "TotalPrice": 7.0}, {"Date": at(2024, 3), "TotalPrice": 8.0},
                 {"Date": None, "OrderDate": at(2024, 1), "TotalPrice": 1.0}])
    assert periods.monthly(df).where("month is not null").count() == 2
    assert rows(periods.monthly_filled(df), "ds") == [
        (dt.date(2024, 1, 31), 0, 7.0), (dt.date(2024, 2, 29), 1, 0.0),
        (dt.date(2024, 3, 31), 2, 8.0)]
    assert rows(periods.month_gaps(df)) == [(dt.date(2024, 2, 1),)]


def test_month_gap_per_group(orders):
    df = orders([{"Region": r, "Date": at(2024, m)} for r, m in
                 (("a", 1), ("a", 4), ("b", 5), (None, 1), (None, 3))])
    assert rows(periods.month_gaps(df, ["Region"]), "Region", "month") == [
        (None, dt.date(2024, 2, 1)), ("a", dt.date(2024, 2, 1)), ("a", dt.date(2024, 3, 1))]


def test_rolling_mean(orders):
    df = orders([{"Date": at(2024, i), "TotalPrice": float(i)} for i in (1, 2, 3, 4)])
    assert [r["rolling"] for r in periods.rolling_mean(df).orderBy("ds").collect()] == [
        None, None, 2.0, 3.0]


@pytest.fixture
def years(orders):
    months = [(2023, m) for m in range(1, 13)] + [(2024, m) for m in range(1, 13)]
    return orders([{"Date": at(y, m), "TotalPrice": 10.0} for y, m in months]
                  + [{"Date": at(2025, m), "TotalPrice": 11.0} for m in range(1, 7)])


def test_partial_year(years):
    got = {r["Year"]: (r["is_partial"], r["last_month"]) for r in periods.annual(years).collect()}
    assert got == {2023: (False, 12), 2024: (False, 12), 2025: (True, 6)}
    for months in (6, None):
        one = periods.like_for_like(years, months).first()
        assert (one["current"], one["previous"], one["previous_full"]) == (66.0, 60.0, 120.0)
        assert one["change_pct"] == pytest.approx(10) and one["annualised"] == 132.0
        assert one["apparent_pct"] == pytest.approx(-45)
    fewer = periods.like_for_like(years, drop_last_month=True).first()
    assert fewer["months_compared"] == 5 and fewer["current"] == 55.0


def test_no_earlier_year_gives_null_not_an_error(orders):
    one = periods.like_for_like(orders([{"Date": at(2024, 2)}])).first()
    assert one["change_pct"] is None and one["previous_full"] is None


def test_same_month_last_year(years):
    got = periods.same_month_last_year(years).orderBy("ds").collect()
    assert got[0]["previous"] is None and got[-1]["change_pct"] == pytest.approx(10)


def test_ticks_and_mean_line(years):
    got = periods.monthly_trend(years).orderBy("month").collect()
    assert [r["position"] for r in got if r["is_tick"]] == list(range(0, 30, 3))
    assert got[0]["mean_revenue"] == pytest.approx((240 + 66) / 30)


def test_pivot(orders):
    df = orders([{"Region": "n", "Product": "x", "TotalPrice": 1.0},
                 {"Region": "s", "Product": "y", "TotalPrice": 2.0},
                 {"Region": None, "Product": "y", "TotalPrice": 4.0}])
    long = crosstab.cells(df, "Region", "Product")
    plain = crosstab.wide(long, "Region", "Product", "revenue", ["x", "y"])
    assert rows(plain, "Region") == [(None, None, 4.0, None), ("n", 1.0, None, None),
                                     ("s", None, 2.0, None)]
    filled = crosstab.wide(long, "Region", "Product", "revenue", ["x", "y"], fill=0.0,
                           drop_null_keys=True)
    assert rows(filled, "Region") == [("n", 1.0, 0.0), ("s", 0.0, 2.0)]
    assert crosstab.by_first_column(filled, "Region").first()["Region"] == "n"
    assert crosstab.grid_difference(df, "Region", "Product").first()["difference"] == 4.0


def test_trend_exact_line(orders):
    df = orders([{"Date": at(2024, i + 1), "TotalPrice": 2.0 * i + 1} for i in range(6)])
    fit = stats.trend_fit(df).first()
    assert (fit["slope"], fit["intercept"], fit["r2"]) == pytest.approx((2, 1, 1))
    assert fit["sigma"] == pytest.approx(0, abs=1e-6) and fit["usable_trend"]
    ahead = stats.trend_forecast(df).orderBy("step").collect()
    assert [r["yhat"] for r in ahead] == pytest.approx([13, 15, 17, 19, 21, 23])
    assert ahead[0]["ds"] == dt.date(2024, 7, 31) and ahead[0]["band"] == pytest.approx(0, abs=1e-6)


def test_flat_and_single_month_series(orders):
    df = orders([{"Region": "flat", "Date": at(2024, m), "TotalPrice": 5.0} for m in (1, 2, 3)]
                + [{"Region": "one", "Date": at(2024, 1)}])
    got = {r["Region"]: r for r in stats.trend_fit(df, ["Region"]).collect()}
    assert got["flat"]["r"] is None and got["flat"]["r2"] is None
    assert not got["flat"]["usable_trend"] and got["flat"]["slope"] == 0
    assert got["one"]["too_short"] and got["one"]["slope"] is None
    assert stats.trend_forecast(df, ["Region"]).count() == 12


def counts(spark, table, dim="d"):
    return spark.createDataFrame([(dim, f"L{i}", r + k, r) for i, (r, k) in enumerate(table)],
                                 "dim string, level string, rated bigint, returned bigint")


def test_chi_square(spark):
    yates = stats.chi_square(counts(spark, [(10, 20), (20, 10)])).first()
    assert yates["chi2"] == pytest.approx(5.4) and yates["dof"] == 1
    wide = stats.chi_square(counts(spark, [(10, 20), (20, 10), (15, 15)])).first()
    assert wide["chi2"] == pytest.approx(6.6666667) and wide["dof"] == 2
    same = stats.chi_square(counts(spark, [(5, 10), (10, 20)])).first()
    assert (same["chi2"], same["p_value"], same["verdict"]) == (0.0, 1.0, "noise")
    none = stats.chi_square(counts(spark, [(0, 10), (0, 20)])).first()
    assert none["p_value"] is None and none["verdict"] is None
    single = stats.chi_square(counts(spark, [(3, 10)])).first()
    assert (single["chi2"], single["p_value"]) == (0.0, 1.0)
    big = stats.chi_square(counts(spark, [(900, 100), (100, 900), (500, 500)])).first()
    assert big["p_value"] == 0.0 and big["verdict"] == "significant"


def test_correlations_with_gaps_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0),
                                (4.0, 8.0, 5.0)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["corr"] for r in
           stats.correlations(df, ["a", "b", "c"]).collect()}
    want = df.toPandas().corr()
    assert len(got) == 9 and got["a", "b"] == pytest.approx(want.loc["a", "b"])
    assert got["b", "a"] == got["a", "b"] and got["a", "a"] == 1.0
    assert got["a", "c"] is None and got["c", "c"] is None


def test_profile(orders):
    df = add_derived(orders([{"UnitPrice": float(v), "Region": r} for v, r in
                             ((1, "a"), (2, None), (3, "a"), (10, "b"))]))
    one = {r["metric"]: r for r in profile.numeric(df, ["UnitPrice"]).collect()}["UnitPrice"]
    want = df.select("UnitPrice").toPandas()["UnitPrice"].describe()
    assert [one[c] for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")] == \
        pytest.approx(list(want))
    assert profile.numeric(df, ["UnitPrice"], approximate=True).first()["p50"] in (2.0, 3.0)
    nulls = {r["column"]: r["nulls"] for r in profile.nulls(df).collect()}
    assert nulls["Region"] == 1 and nulls["Promotion"] == 4 and nulls["Product"] == 0
    cats = {r["column"]: tuple(r)[1:] for r in
            profile.category_counts(df, ["Region", "Product"]).collect()}
    assert cats == {"Region": (2, 1), "Product": (1, 0)}
    assert profile.shape(df).where("column = 'Year'").first()["rows"] == 4


def test_kpis(years):
    df = add_derived(years)
    cards = kpi.kpi_cards(df).first()
    assert cards["lines"] == 30 and cards["orders_per_month"] == 1.0 and cards["days"] == 30
    assert cards["median_order_value"] == 10.0 and cards["gross_revenue"] == pytest.approx(306)
    assert kpi.kpi_cards(df, approximate=True).first()["median_order_value"] == 10.0
    assert tuple(kpi.hero_counts(df).first()) == (1, 1, 1, 30)
    assert tuple(kpi.hero_counts(df, approximate=True).first()) == (1, 1, 1, 30)
    assert kpi.kpi_global(df).first()["lost_revenue"] == 0


def test_notes(orders):
    df = orders([{"Product": p, "Region": r, "Salesperson": s, "Returned": x, "Promotion": "SAVE10",
                  "Date": at(y, 1 + i % 6)} for i, (p, r, s, x, y) in enumerate(
        [("a", "n", "u", 1, 2023), ("a", "s", "v", 0, 2024), ("b", "n", "v", 0, 2023),
         ("b", "s", "u", 0, 2024), ("a", "n", "u", 1, 2024)])])
    got = {(r["note"], r["subject"]): r["text"] for r in notes.all_notes(df).collect()}
    assert set(got) == {("returns", "Product"), ("partial year", "2024"),
                        ("promotions", "SAVE10"), ("promotions", "(all)")}
    assert "highest is a" in got["returns", "Product"]
    assert "5 of 5" in got["promotions", "SAVE10"]


def test_report_is_written_whole(spark, orders, tmp_path):
    raw = orders([{"OrderID": f"O{i}", "Region": "ns"[i % 2], "Product": "xyz"[i % 3],
                   "Salesperson": "uv"[i % 2], "CustomerType": "rw"[(i // 2) % 2],
                   "Discount": (i % 4) * 0.05, "Quantity": 1 + i % 7, "UnitPrice": 5.0 + i % 11,
                   "ShippingCost": float(i % 5), "Returned": int(i % 4 == 0),
                   "Promotion": "SAVE10" if i % 2 else None,
                   "Date": at(2023 + i // 60, 1 + i % 12)} for i in range(120)])
    unfilled = add_derived(raw)
    full = unfilled.withColumn("Promotion", fill_promotion(F.col("Promotion")))
    written = report.write_report(full, unfilled, str(tmp_path / "out"))
    assert {"checks", "kpis", "notes", "chart=c-trend", "chart=c-heat", "chart=forecast",
            "chart=correlation"} <= set(written)
    read = report.read_report(spark, str(tmp_path / "out"))
    assert sorted(read) == written
    total = full.agg(F.sum("TotalPrice")).first()[0]
    for chart in ("c-region", "c-product", "c-payment", "c-promo", "c-sales", "c-heat", "c-year"):
        table = read[f"chart={chart}"]
        assert table.agg(F.sum("revenue")).first()[0] == pytest.approx(total), chart
    share = read["chart=c-payment"]
    assert share.agg(F.sum("share_pct")).first()[0] == pytest.approx(100)
    status = {r["check"]: r["status"] for r in read["checks"].collect()}
    assert status["promotion_complete"] == "fail" and status["no_duplicates"] == "pass"


def test_report_joins_the_tables_once(spark):
    """Sales and unfilled sales come from one written join, and are not written again."""
    import __spark_entry__ as registered
    from tallymark import session
    mark = session.intermediates()
    cells = registered.report_tables(spark, "/root/testdata/sf0.001").count()
    labels = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._made[mark:]]
    assert cells > 100 and labels.count("report-raw") == 1
    assert not {"report-sales", "report-unfilled"} & set(labels)

import datetime as dt

import pytest

from tallymark.operators import checks
from tallymark.operators.clean import add_derived


def status(df, **kw):
    return {r["check"]: (r["status"], r["observed"], r["detail"])
            for r in checks.all_checks(add_derived(df), **kw).collect()}


def test_good_orders_pass(orders):
    df = orders([{"Promotion": "A", "Date": dt.datetime(2024, m, 1)} for m in (1, 2, 3)])
    got = status(df)
    assert len(got) == 9 and {s for s, _, _ in got.values()} == {"pass"}
    tally = checks.tally(checks.all_checks(add_derived(df))).first()
    assert tuple(tally) == (9, 0, 0, "pass")


def test_each_fault_is_seen(orders):
    rows = [{"Promotion": "A", "OrderID": "X"}, {"Promotion": "A", "OrderID": "X"},
            {"Promotion": None, "Region": None, "TotalPrice": 50.0},
            {"Promotion": "A", "Date": dt.datetime(2024, 4, 1),
             "DeliveryDate": dt.datetime(2024, 3, 1)},
            {"Promotion": "A", "TotalPrice": 0.0}, {"Promotion": "A", "Discount": None,
                                                    "TotalPrice": 9.0}]
    got = status(orders(rows))
    assert got["no_duplicates"][:2] == ("fail", 1.0)
    assert got["revenue_arithmetic"][0] == "fail" and got["revenue_arithmetic"][1] == 200.0
    assert got["promotion_complete"][:2] == ("fail", 1.0)
    assert got["delivery_after_order"][:2] == ("fail", 1.0)
    assert got["breakdowns_cover_total"][0] == "fail"
    assert got["breakdowns_cover_total"][2] == "Region, Promotion"
    assert got["positive_price"][:2] == ("fail", 1.0)
    assert got["discount_known"][:2] == ("fail", 1.0)
    assert got["months_without_gap"][0] == "warn"
    assert got["months_without_gap"][2] == "missing: 2024-02, 2024-03"
    tally = checks.tally(checks.all_checks(add_derived(orders(rows)))).first()
    assert tally["overall"] == "fail"


def test_gap_only_warns(orders):
    df = orders([{"Promotion": "A", "Date": dt.datetime(2024, m, 1)} for m in (1, 3)])
    assert checks.tally(checks.all_checks(add_derived(df))).first()["overall"] == "pass"


def test_volume_threshold(orders):
    df = orders([{"Promotion": "A", "Product": p} for p in "aaab"])
    assert status(df)["comparable_volume"][:2] == ("warn", 3.0)
    assert status(df, max_ratio=3.0)["comparable_volume"][0] == "pass"


def test_reconcile_counts_null_keys(orders):
    df = orders([{"Region": "a", "TotalPrice": 1.0}, {"Region": None, "TotalPrice": 2.0}])
    got = {r["dim"]: (r["delta"], r["status"]) for r in
           checks.reconcile(df, ["Region", "Product"]).collect()}
    assert got == {"Region": (2.0, "fail"), "Product": (0.0, "pass")}


def test_identity(orders):
    assert checks.is_identity(orders([{}])).first()["target_leakage"]
    assert not checks.is_identity(orders([{"TotalPrice": 1.0}])).first()["target_leakage"]


def test_no_rows(orders):
    got = status(orders([]))
    assert got["no_duplicates"][0] == "pass" and got["positive_price"][0] == "pass"


@pytest.mark.parametrize("delta, want", [(0.0, "OK"), (1.0, "MISMATCH")])
def test_compare_copies(orders, delta, want):
    a, b = orders([{"Promotion": "p"}]), orders([{"Promotion": "p", "TotalPrice": 200.0 + delta}])
    got = {r["item"]: r["status"] for r in checks.compare_copies(a, b, ["Region"]).collect()}
    assert got["total_by_Region"] == want and got["rows"] == "OK"

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Spark's Python workers import the package, too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from tallymark.schema import raw_schema  # noqa: E402
from tallymark.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", "tests", {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def orders(spark):
    """Build raw orders from keyword rows; anything left out has a default."""
    schema = raw_schema()
    default = {
        "OrderID": None, "Date": dt.datetime(2024, 1, 15), "OrderDate": None,
        "DeliveryDate": None, "Region": "North", "Product": "Desk", "CustomerType": "Retail",
        "PaymentMethod": "Cash", "Promotion": None, "StoreLocation": "S1", "Salesperson": "Ann",
        "RegionManager": "Max", "Quantity": 2, "UnitPrice": 100.0, "Discount": 0.0,
        "TotalPrice": None, "ShippingCost": 5.0, "Returned": 0}

    def build(rows: list[dict]):
        full = []
        for i, row in enumerate(rows):
            r = {**default, **row}
            r["OrderID"] = r["OrderID"] if "OrderID" in row else f"O{i}"
            r["OrderDate"] = r["OrderDate"] or r["Date"]
            if r["DeliveryDate"] is None and r["OrderDate"] is not None:
                r["DeliveryDate"] = r["OrderDate"] + dt.timedelta(days=5)
            if "TotalPrice" not in row and r["Discount"] is not None:
                r["TotalPrice"] = r["Quantity"] * r["UnitPrice"] * (1 - r["Discount"])
            full.append(tuple(r[f.name] for f in schema.fields))
        return spark.createDataFrame(full, schema)

    return build


def rows(df, *keys):
    return [tuple(r) for r in (df.orderBy(*keys) if keys else df).collect()]

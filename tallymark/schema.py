"""Column names, types and fixed values of the sales fact table."""

from __future__ import annotations

from pyspark.sql import types as T

# The labels and tokens below are part of the results.
NO_PROMOTION = "No Promotion"
NULL_TOKENS = ["", "NA", "NaN", "nan", "null", "NULL"]
DISCOUNT_BUCKETS = ["No Discount", "Low (1–5%)", "Mid (6–10%)", "High (11–15%)"]

DATES = ["Date", "OrderDate", "DeliveryDate"]
CATEGORIES = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion",
              "StoreLocation", "Salesperson", "RegionManager"]
PROFILED = ["Quantity", "UnitPrice", "TotalPrice", "ShippingCost", "DeliveryDays"]
CORRELATED = ["Quantity", "UnitPrice", "Discount", "TotalPrice", "ShippingCost",
              "DeliveryDays", "Returned"]
RECONCILED = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion",
              "Salesperson", "Year"]


def raw_schema(money: T.DataType | None = None) -> T.StructType:
    """Schema of the raw order table; pass a DecimalType to keep money exact."""
    money = money or T.DoubleType()
    text, stamp = T.StringType(), T.TimestampNTZType()
    return T.StructType([
        T.StructField("OrderID", text),
        T.StructField("Date", stamp),
        T.StructField("OrderDate", stamp),
        T.StructField("DeliveryDate", stamp),
        *[T.StructField(c, text) for c in CATEGORIES],
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("UnitPrice", money),
        T.StructField("Discount", T.DoubleType()),
        T.StructField("TotalPrice", money),
        T.StructField("ShippingCost", money),
        T.StructField("Returned", T.IntegerType()),
    ])


def clean_schema(money: T.DataType | None = None) -> T.StructType:
    """Raw schema plus the nine derived columns, in the order they are written."""
    money = money or T.DoubleType()
    return T.StructType(raw_schema(money).fields + [
        T.StructField("DeliveryDays", T.IntegerType()),
        T.StructField("CalcRevenue", money),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Quarter", T.IntegerType()),
        T.StructField("YearMonth", T.StringType()),
        T.StructField("NetRevenue", money),
        T.StructField("GrossProfit", money),
        T.StructField("DiscountBucket", T.StringType()),
    ])


RAW_COLUMNS = raw_schema().fieldNames()
CLEAN_COLUMNS = clean_schema().fieldNames()

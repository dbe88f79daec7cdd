"""Sales fact table built from a star schema of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.derive import DERIVED, fill_promotion
from tallymark.schema import CLEAN_COLUMNS

UNSPECIFIED_PRIORITY = "4-NOT SPECIFIED"

FROM_ORDERS = {"Date", "OrderDate", "Promotion"}
FROM_CUSTOMER = {"PaymentMethod"}
FROM_CUSTOMER_NATION = {"Region", "StoreLocation"}
FROM_PART = {"Product"}
FROM_SUPPLIER = {"Salesperson"}
FROM_SUPPLIER_REGION = {"RegionManager"}


def raw_inputs(names) -> set[str]:
    """Raw columns needed to produce `names`, derived columns included."""
    needed: set[str] = set()
    for name in names:
        needed.update(DERIVED[name][0] if name in DERIVED else [name])
    return needed


def raw_sales(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Raw sales columns `names` (all when none given), one row per order line.

    Only the tables the columns need are joined. Joins are left joins on the
    dimension's key, so no sale is lost and leaving a table out changes nothing
    else. Orders and customers are joined before the lines, so the lines are
    shuffled once for both, and parts and suppliers come first, while the lines are
    narrow: the rows then lie by order. No side is forced to broadcast: Spark does so for
    tables below its size threshold, and AQE splits skewed keys of the others.
    """
    wanted = list(names) or [c for c in CLEAN_COLUMNS if c not in DERIVED]
    need = set(wanted)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    fact = table("lineitem").select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("l_partkey").alias("_part"),
        F.col("l_suppkey").alias("_supplier"),
        F.col("l_shipdate").alias("DeliveryDate"),
        F.col("l_linestatus").alias("CustomerType"),
        F.col("l_quantity").alias("Quantity"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("UnitPrice"),
        F.col("l_discount").alias("Discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("TotalPrice"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("ShippingCost"),
        (F.col("l_returnflag") == "R").cast("int").alias("Returned"),
    )

    def nation_names(with_region: bool) -> DataFrame:
        nation = table("nation").select("n_nationkey", "n_name", "n_regionkey")
        if not with_region:
            return nation
        return nation.join(table("region").select("r_regionkey", "r_name"),
                           nation.n_regionkey == F.col("r_regionkey"), "left")

    if need & FROM_PART:
        part = table("part").select("p_partkey", F.col("p_type").alias("Product"))
        fact = fact.join(part, F.col("_part") == F.col("p_partkey"), "left")

    if need & (FROM_SUPPLIER | FROM_SUPPLIER_REGION):
        supplier = table("supplier").select(
            "s_suppkey", "s_nationkey", F.col("s_name").alias("Salesperson"))
        fact = fact.join(supplier, F.col("_supplier") == F.col("s_suppkey"), "left")
        if need & FROM_SUPPLIER_REGION:
            nation = nation_names(True).select(
                F.col("n_nationkey").alias("_s_nation"), F.col("r_name").alias("RegionManager"))
            fact = fact.join(nation, F.col("s_nationkey") == F.col("_s_nation"), "left")

    by_customer = FROM_CUSTOMER | FROM_CUSTOMER_NATION
    if need & (FROM_ORDERS | by_customer):
        orders = table("orders").select(
            F.col("o_orderkey").alias("_order"),
            F.col("o_custkey").alias("_customer"),
            F.col("o_orderdate").alias("Date"),
            F.col("o_orderdate").alias("OrderDate"),
            F.nullif("o_orderpriority", F.lit(UNSPECIFIED_PRIORITY)).alias("Promotion"))
        if need & by_customer:
            customer = table("customer").select(
                "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("PaymentMethod"))
            if need & FROM_CUSTOMER_NATION:
                nation = nation_names("Region" in need)
                region = [F.col("r_name").alias("Region")] if "Region" in need else []
                customer = customer.join(
                    nation.select(F.col("n_nationkey").alias("_nation"),
                                  F.col("n_name").alias("StoreLocation"), *region),
                    F.col("c_nationkey") == F.col("_nation"), "left")
            orders = orders.join(customer, F.col("_customer") == F.col("c_custkey"), "left")
        fact = fact.join(orders, F.col("OrderID") == F.col("_order"), "left")

    return fact.select(*wanted)


def sales(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Cleaned sales columns `names`: promotion filled, derived columns added."""
    wanted = list(names) or CLEAN_COLUMNS
    inputs = raw_inputs(wanted)
    df = raw_sales(spark, folder, *sorted(inputs))
    if "Promotion" in inputs:
        df = df.withColumn("Promotion", fill_promotion(F.col("Promotion")))
    return df.select(*[DERIVED[n][1]().alias(n) if n in DERIVED else F.col(n) for n in wanted])

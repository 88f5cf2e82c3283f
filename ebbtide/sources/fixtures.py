"""The TPC-H-like test tables in the shape of raw retail transactions, with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Remainder of the nation's key by seven, and the country's name.
COUNTRIES = {0: "United Kingdom", 1: "France", 2: "Germany"}

# The columns read, with their types: nothing has to be inferred from the files first.
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_extendedprice double, l_returnflag string, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as transactions: returns, special codes, gaps and copies by key arithmetic."""
    # some nations under names of each country group
    country = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])[F.col("n_nationkey") % 7]
    nations = _table(spark, folder, "nation").withColumn("country", F.coalesce(country, "n_name"))
    suppliers = (
        _table(spark, folder, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), "country")
    )
    parts = _table(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
    orders = _table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    lines = (
        _table(spark, folder, "lineitem")
        .join(orders, "l_orderkey")
        .join(parts, "l_partkey")
        .join(suppliers, "l_suppkey")
    )
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    # every 50th order comes twice
    copies = F.when(order % 50 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return lines.withColumn("copy", F.explode(copies)).select(
        F.concat(F.when(returned, "C").otherwise(""), order.cast("string")).alias("Invoice"),
        F.when(part % 97 == 0, "POST")
        .when(part % 89 == 0, F.concat(F.lit("test"), (part % 10).cast("string")))
        .otherwise(F.concat(F.lit("P"), (part % 200).cast("string"))).alias("StockCode"),
        F.when(part % 61 != 0, F.col("p_name")).alias("Description"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(order % 10 + 8).cast("int")))
        .alias("InvoiceDate"),
        F.when(part % 151 == 0, 0.0)
        .otherwise(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5) / 100)
        .alias("Price"),
        F.when(order % 20 != 0, F.col("o_custkey").cast("string")).alias("Customer ID"),
        F.col("country").alias("Country"),
    )


def purchase_events(spark: SparkSession, folder: str) -> DataFrame:
    """The purchase events as transactions; times reach to the microsecond."""
    return (
        _table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").cast("string").alias("customer_id"),
            F.col("event_id").cast("string").alias("invoice_no"),
            F.col("ts").alias("invoice_date"),
            F.col("value").alias("line_amount"),
        )
    )

"""Reading transaction tables, parameters, metrics and models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.calendar import parse_ts
from ebbtide.functions.scalars import canonical_id, normalize_columns, with_line_amount
from ebbtide.runtime import resolved_row

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("invoice_no", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("invoice_date", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("country", T.StringType()),
])

CLEAN_SCHEMA = T.StructType([
    T.StructField("unit_price", f.dataType) if f.name == "price" else f for f in TRANSACTION_SCHEMA
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row; dates are parsed by the schema."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(path)
    )


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Raw transactions as they lie there; a missing path raises ``AnalysisException``."""
    if fmt == "csv":
        return read_csv(spark, path, schema or TRANSACTION_SCHEMA)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """One layout whatever the source headers: eight typed columns and the line amount."""
    named = normalize_columns(raw)
    return with_line_amount(
        named.select(
            F.col("invoice_no").cast("string").alias("invoice_no"),
            F.col("stock_code").cast("string").alias("stock_code"),
            F.col("description").cast("string").alias("description"),
            F.col("quantity").cast("int").alias("quantity"),
            parse_ts(F.col("invoice_date")).alias("invoice_date"),
            F.col("price").cast("double").alias("price"),
            F.col("customer_id").cast("string").alias("customer_id"),
            F.col("country").cast("string").alias("country"),
        )
    )


def read_clean_or_raw(
    spark: SparkSession, clean_path: str, raw_path: str, fmt: str = "parquet"
) -> DataFrame:
    """The clean table, or the raw one with only the rows lacking a customer or date removed."""
    try:
        table = read_transactions(spark, clean_path, fmt, CLEAN_SCHEMA if fmt == "csv" else None)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = read_transactions(spark, raw_path, fmt)
        table = (
            typed_transactions(raw)
            .filter(F.col("customer_id").isNotNull() & F.col("invoice_date").isNotNull())
            .drop("line_amount")
            .withColumnRenamed("price", "unit_price")
        )
    by_number = canonical_id(F.col("customer_id"), "numeric")
    return with_line_amount(table.withColumn("customer_id", by_number), "unit_price")


def resolve_observation_date(purchases: DataFrame, metadata: DataFrame | None = None) -> Column:
    """The recorded observation date, else the latest purchase."""
    if metadata is not None:
        recorded = metadata.filter(F.col("Metric") == "Observation Date (for churn window)").agg(
            F.max(parse_ts(F.col("Value"))).alias("at")
        )
        if recorded.first()["at"] is not None:
            return resolved_row(recorded)["at"]
    return resolved_row(purchases.agg(F.max("invoice_date").alias("at")))["at"]


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

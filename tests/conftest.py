import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        # small inputs would otherwise end up in one partition and hide ordering mistakes
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make transaction lines from (invoice, stock, description, quantity, time, price, customer, country)."""
    from pyspark.sql import functions as F

    def make(rows, price="price"):
        frame = spark.createDataFrame(
            rows,
            f"invoice_no string, stock_code string, description string, quantity int, "
            f"invoice_date string, {price} double, customer_id string, country string",
        )
        return frame.withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz")).withColumn(
            "line_amount", F.col("quantity") * F.col(price)
        )

    return make

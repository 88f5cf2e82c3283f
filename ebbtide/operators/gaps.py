"""Time between a customer's consecutive purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.calendar import calendar_days, elapsed_days, midnight
from ebbtide.operators.ordering import with_previous


def purchase_events(pur: DataFrame, grain: str) -> DataFrame:
    """What counts as one purchase: ``invoice`` (customer, invoice, time), ``timestamp``
    (customer, time) or ``day`` (customer, date)."""
    if grain == "invoice":
        return pur.select("customer_id", "invoice_no", F.col("invoice_date").alias("purchased_at")).distinct()
    if grain == "timestamp":
        return pur.select("customer_id", F.col("invoice_date").alias("purchased_at")).distinct()
    if grain == "day":
        return pur.select("customer_id", midnight(F.col("invoice_date")).alias("purchased_at")).distinct()
    raise ValueError(f"unknown grain: {grain}")


def purchase_gaps(pur: DataFrame, grain: str) -> DataFrame:
    """Each purchase after a customer's first, with the previous one and the days between.

    A customer has few distinct days however many purchases, so the ``day`` grain looks back
    in a window per customer. The other grains have no such bound and use the global order.
    """
    keys, at = ["customer_id"], F.col("purchased_at")
    events = purchase_events(pur, grain).filter(F.col("customer_id").isNotNull() & at.isNotNull())
    previous = F.col("previous_at")
    if grain == "day":
        earlier = Window.partitionBy(*keys).orderBy("purchased_at")
        looked_back = events.withColumn("previous_at", F.lag("purchased_at").over(earlier))
        days = calendar_days(previous, at)
    else:
        order = [c for c in ("purchased_at", "invoice_no") if c in events.columns]
        looked_back = with_previous(events, keys, order, "purchased_at", "previous_at")
        days = elapsed_days(previous, at)
    return looked_back.filter(previous.isNotNull()).withColumn("gap_days", days)


def gap_features(gaps: DataFrame) -> DataFrame:
    """Mean, median and longest gap per customer. The median counts equal day values, of which
    there are few however many purchases a customer has."""
    return gaps.groupBy("customer_id").agg(
        F.avg("gap_days").alias("avg_gap_days"),
        F.median("gap_days").alias("median_gap_days"),
        F.max("gap_days").cast("double").alias("max_gap_days"),
    )


def fill_gaps(features: DataFrame, age: Column) -> DataFrame:
    """Customers without a gap get their age instead."""
    names = ["avg_gap_days", "median_gap_days", "max_gap_days"]
    return features.withColumns({c: F.coalesce(F.col(c), age.cast("double")) for c in names})


GAP_POINTS = [0.5, 0.75, 0.9, 0.95, 0.99]


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Distribution of the gaps and the number of repeat customers, in one row."""
    names = [f"p{round(p * 100)}" for p in GAP_POINTS]
    return gaps.agg(
        F.count("gap_days").alias("gaps"),
        F.count_distinct("customer_id").alias("repeat_customers"),
        F.avg("gap_days").alias("mean"),
        F.stddev_samp("gap_days").alias("std"),
        F.min("gap_days").alias("min"),
        F.percentile("gap_days", GAP_POINTS).alias("_q"),
        F.max("gap_days").alias("max"),
    ).select(
        "gaps", "repeat_customers", "mean", "std", "min",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(names)], "max",
    )

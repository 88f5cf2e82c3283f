"""What counts as churned, and the labelled modelling table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.calendar import elapsed_days, midnight, minus_days
from ebbtide.functions.scalars import as_flag, cut
from ebbtide.operators.features import PRICE, WINDOW_FEATURE_COLUMNS, window_features
from ebbtide.operators.gaps import purchase_gaps
from ebbtide.operators.grains import holds
from ebbtide.operators.quality import is_purchase
from ebbtide.runtime import resolved_row


def churn_threshold(
    gaps: DataFrame, point: float = 0.9, step: int = 30, lo: int = 60, hi: int = 120
) -> DataFrame:
    """Days without a purchase after which a customer counts as churned, in one row.

    The gaps' 90th percentile to the nearest ``step`` (halves to even), within ``lo..hi``.
    """
    quantile = gaps.agg(F.percentile("gap_days", F.lit(point)).alias("gap_quantile"))
    rounded = F.bround(F.col("gap_quantile") / step) * step
    return quantile.withColumn(
        "threshold_days", F.least(F.greatest(rounded, F.lit(lo)), F.lit(hi)).cast("int")
    )


@dataclass(frozen=True)
class Windows:
    """The observation window and the label window after it."""

    obs_start: Column
    snapshot: Column
    label_end: Column


def window_table(pur: DataFrame, threshold: Column) -> DataFrame:
    """Observation start, snapshot and label end in one row.

    The snapshot is a midnight, the label end the last purchase, so that the last day's buyers
    are inside. An empty label window raises.
    """
    span = pur.agg(F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"))
    return span.select(
        midnight(F.col("lo")).alias("obs_start"),
        midnight(minus_days(F.col("hi"), threshold)).alias("snapshot"),
        F.col("hi").alias("label_end"),
        threshold.cast("int").alias("threshold_days"),
    ).withColumn(
        "snapshot",
        F.when(F.col("label_end") > F.col("snapshot"), F.col("snapshot")).otherwise(
            F.raise_error(F.lit("label window is empty")).cast("timestamp_ntz")
        ),
    )


def churn_windows(pur: DataFrame, threshold: Column) -> Windows:
    found = resolved_row(window_table(pur, threshold))
    return Windows(found["obs_start"], found["snapshot"], found["label_end"])


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("churn_label", as_flag(F.col("future_orders") == 0))


def label_churn(features: DataFrame, pur: DataFrame, windows: Windows) -> DataFrame:
    """Add orders after the snapshot, up to the label end, and whether there were none."""
    ts = F.col("invoice_date")
    future = (
        pur.filter((ts > windows.snapshot) & (ts <= windows.label_end))
        .groupBy("customer_id")
        .agg(F.count_distinct("invoice_no").alias("future_orders"))
    )
    joined = features.join(future, "customer_id", "left").withColumn(
        "future_orders", F.coalesce("future_orders", F.lit(0))
    )
    return with_label(joined)


def modeling_dataset(clean: DataFrame, windows: Windows) -> DataFrame:
    """The 34-column labelled table. Features and label come out of the same aggregation."""
    ts = F.col("invoice_date")
    later = is_purchase("not_return", PRICE) & (ts > windows.snapshot) & (ts <= windows.label_end)
    future_orders = holds(F.when(later, F.col("invoice_no")).isNotNull())
    table = window_features(
        clean, windows.obs_start, windows.snapshot, {"future_orders": future_orders}
    )
    return with_label(table.withColumn("snapshot_date", windows.snapshot)).select(
        *WINDOW_FEATURE_COLUMNS, "snapshot_date", "future_orders", "churn_label"
    )


def derived_windows(clean: DataFrame) -> Windows:
    """Windows under the threshold derived from the customers' own gaps between purchase days."""
    pur = clean.filter(is_purchase("not_return", PRICE))
    threshold = resolved_row(churn_threshold(purchase_gaps(pur, "day")))["threshold_days"]
    return churn_windows(pur, threshold)


def class_balance(df: DataFrame, column: str = fv.LABEL) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def churn_by_recency(model_df: DataFrame) -> DataFrame:
    bucket = cut(F.col("recency_days"), fv.RECENCY_EDGES, fv.RECENCY_BUCKETS)
    return model_df.groupBy(bucket.alias("recency_bucket")).agg(
        F.avg("churn_label").alias("churn_rate")
    )


def churn_rate_curve(pur: DataFrame, lo: int = 30, hi: int = 180, step: int = 5) -> DataFrame:
    """Eligible and churned customers for every inactivity threshold of a grid.

    Under a longer threshold the snapshot is earlier, so each customer is eligible, and counts
    as churned, up to some longest threshold. Customers are counted by that threshold and the
    counts summed over the grid's few rows: no row per customer and threshold.
    """
    latest = pur.agg(F.max("invoice_date").alias("at")).scalar()
    per_customer = pur.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last")
    )
    # the snapshot for t days is t midnights before the latest day
    longest = lambda c: elapsed_days(F.col(c), midnight(latest))
    cell = lambda c: F.least(
        F.floor((longest(c) - lo) / step), F.lit((hi - lo) // step)
    )
    reached = (
        per_customer.select(F.inline(F.array(
            F.struct(cell("first").alias("cell"), F.lit(1).alias("eligible"), F.lit(0).alias("churned")),
            F.struct(cell("last").alias("cell"), F.lit(0).alias("eligible"), F.lit(1).alias("churned")),
        )))
        .filter(F.col("cell") >= 0)
        .groupBy("cell")
        .agg(F.sum("eligible").alias("eligible"), F.sum("churned").alias("churned"))
    )
    spark = pur.sparkSession
    grid = spark.range(0, (hi - lo) // step + 1, numPartitions=1).withColumnRenamed("id", "cell")
    at_least = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(at_least), F.lit(0))
    return (
        grid.join(reached, "cell", "left")
        .select(
            (F.col("cell") * step + lo).cast("int").alias("threshold_days"),
            total("eligible").alias("n_eligible"),
            total("churned").alias("n_churned"),
        )
        .withColumn(
            "churn_rate", F.round(F.try_divide(F.col("n_churned"), F.col("n_eligible")), 4)
        )
        .orderBy("threshold_days")
    )


def at_value(curve: DataFrame, column: str, value) -> DataFrame:
    """The row of a curve or sweep at one parameter value."""
    return curve.filter(F.col(column) == value)

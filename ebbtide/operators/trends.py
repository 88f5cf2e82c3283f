"""Sales by product, period, weekday, hour, order count and country, and cohort retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.calendar import calendar_parts, month_index, month_start, month_text, week_end
from ebbtide.functions.scalars import cut
from ebbtide.operators.customers import most_common
from ebbtide.runtime import one_row


def complete(df: DataFrame, column: str, domain: Sequence, zero: Sequence[str] = ()) -> DataFrame:
    """One row per value of a fixed domain, in its order; counts named in ``zero`` become 0."""
    values = [(value, i) for i, value in enumerate(domain, start=1)]
    frame = df.sparkSession.createDataFrame(
        values, f"{column} {df.schema[column].dataType.simpleString()}, position int"
    )
    joined = frame.join(df, column, "left").orderBy("position")
    return joined.fillna(0, subset=list(zero)) if zero else joined


def product_totals(pur: DataFrame) -> DataFrame:
    """Quantity and revenue per stock code with its most common description.

    Sums come first, so names are joined to one row per code, not to every line.
    """
    names = most_common(pur, "stock_code", "description", "_name")
    return (
        pur.groupBy("stock_code")
        .agg(F.sum("quantity").alias("quantity"), F.sum("line_amount").alias("revenue"))
        .join(names, "stock_code", "left")
        .withColumn("product_name", F.coalesce("_name", "stock_code"))
        .drop("_name")
    )


def top_products(pur: DataFrame, by: str = "quantity", n: int = 10) -> DataFrame:
    return product_totals(pur).orderBy(F.desc(by), "stock_code").limit(n)


def monthly_trend(pur: DataFrame) -> DataFrame:
    return (
        pur.groupBy(month_start(F.col("invoice_date")).alias("order_month"))
        .agg(
            F.sum("line_amount").alias("revenue"),
            F.count_distinct("invoice_no").alias("orders"),
            F.count_distinct("customer_id").alias("active_customers"),
        )
        .orderBy("order_month")
    )


def mom_growth(monthly: DataFrame) -> DataFrame:
    """Percent change on the row before, of revenue, orders and customers. The first has none."""
    by_month = Window.orderBy("order_month")

    def change(c: str):
        before = F.lag(c).over(by_month)
        return (F.try_divide(F.col(c).cast("double"), before.cast("double")) - 1) * 100

    return monthly.withColumns({
        "revenue_mom_pct": change("revenue"),
        "orders_mom_pct": change("orders"),
        "customers_mom_pct": change("active_customers"),
    })


def flag_partial_month(monthly: DataFrame, pur: DataFrame) -> DataFrame:
    """Mark the last month where the data end before its last day."""
    latest = one_row(pur.agg(F.to_date(F.max("invoice_date")).alias("day")))["day"]
    is_last = F.to_date("order_month") == F.trunc(latest, "month")
    return monthly.withColumn("is_partial", is_last & (latest < F.last_day(latest)))


def growth_summary(growth: DataFrame) -> DataFrame:
    """Peak and trough month by revenue, and mean revenue growth."""
    month = month_text(F.col("order_month"))
    return growth.agg(
        F.max_by(month, "revenue").alias("peak_month"),
        F.min_by(month, "revenue").alias("trough_month"),
        F.avg("revenue_mom_pct").alias("avg_revenue_mom_pct"),
    )


def monthly_net_revenue(tx: DataFrame, pur: DataFrame) -> DataFrame:
    """Value of all lines, returns included, and distinct purchase orders per month."""
    month = month_text(F.col("invoice_date")).alias("month")
    net = tx.groupBy(month).agg(F.round(F.sum("line_amount"), 2).alias("net_revenue"))
    orders = pur.groupBy(month).agg(F.count_distinct("invoice_no").alias("orders"))
    return net.join(orders, "month", "left").orderBy("month")


def weekly_counts(pur: DataFrame) -> DataFrame:
    """Purchase lines per week, dated by its closing Sunday, weeks without sales included."""
    counted = pur.groupBy(week_end(F.col("invoice_date")).alias("week")).agg(
        F.count("line_amount").alias("lines")
    )
    weeks = counted.agg(
        F.sequence(F.min("week"), F.max("week"), F.make_dt_interval(F.lit(7))).alias("w")
    ).select(F.explode("w").alias("week"))
    return (
        weeks.join(counted, "week", "left")
        .withColumn("lines", F.coalesce("lines", F.lit(0)))
        .orderBy("week")
    )


def purchases_by_weekday(pur: DataFrame) -> DataFrame:
    summary = (
        calendar_parts(pur, "invoice_date")
        .groupBy(F.col("weekday").alias("day_of_week"))
        .agg(
            F.count_distinct("invoice_no").alias("orders"),
            F.sum("line_amount").alias("revenue"),
            F.count_distinct("customer_id").alias("customers"),
        )
    )
    return complete(summary, "day_of_week", fv.WEEKDAYS)


def purchases_by_hour(pur: DataFrame) -> DataFrame:
    return (
        calendar_parts(pur, "invoice_date")
        .groupBy(F.col("hour").alias("hour_of_day"))
        .agg(
            F.count_distinct("invoice_no").alias("orders"),
            F.sum("line_amount").alias("revenue"),
        )
        .orderBy("hour_of_day")
    )


def timing_summary(pur: DataFrame) -> DataFrame:
    """Busiest and quietest weekday, peak hour and the weekend's share of orders.

    The share divides sums of per-day distinct orders, so an order over two days counts twice.
    """
    days = purchases_by_weekday(pur).filter(F.col("orders").isNotNull())
    weekend = F.col("day_of_week").isin("Saturday", "Sunday")
    # on equal counts the earlier day or hour wins
    peak_hour = purchases_by_hour(pur).agg(
        F.max_by("hour_of_day", F.struct("orders", -F.col("hour_of_day"))).alias("h")
    )
    return days.agg(
        F.max_by("day_of_week", F.struct("orders", -F.col("position"))).alias("busiest_day"),
        F.min_by("day_of_week", F.struct("orders", F.col("position"))).alias("quietest_day"),
        F.sum(F.when(weekend, F.col("orders")).otherwise(0)).alias("weekend_orders"),
        F.sum("orders").alias("_all"),
    ).select(
        "busiest_day", "quietest_day", peak_hour.scalar().alias("peak_hour"), "weekend_orders",
        (F.col("weekend_orders") * 100.0 / F.col("_all")).alias("weekend_pct"),
    )


def customer_orders(pur: DataFrame) -> DataFrame:
    return pur.groupBy("customer_id").agg(
        F.count_distinct("invoice_no").alias("orders"), F.sum("line_amount").alias("spend")
    )


def order_buckets(pur: DataFrame) -> DataFrame:
    """Customers by number of orders, empty buckets included."""
    bucket = cut(F.col("orders"), fv.ORDER_EDGES, fv.ORDER_BUCKETS).alias("order_bucket")
    counted = customer_orders(pur).groupBy(bucket).agg(F.count(F.lit(1)).alias("customers"))
    return complete(counted, "order_bucket", fv.ORDER_BUCKETS, zero=["customers"])


def country_summary(
    pur: DataFrame, by: str = "revenue", exclude: str | None = None, n: int | None = None
) -> DataFrame:
    """Customers and revenue per country, largest first, optionally without the home country."""
    source = pur if exclude is None else pur.filter(F.col("country") != exclude)
    summary = (
        source.groupBy("country")
        .agg(
            F.count_distinct("customer_id").alias("customers"),
            F.sum("line_amount").alias("revenue"),
        )
        .orderBy(F.desc(by), "country")
    )
    return summary if n is None else summary.limit(n)


def with_cohort(pur: DataFrame) -> DataFrame:
    """Distinct months each customer bought in, with the first one and the months since.

    Reduced to (customer, month) before the window, so a customer holds one row per month.
    """
    months = pur.select("customer_id", month_start(F.col("invoice_date")).alias("invoice_month")).distinct()
    first = F.min("invoice_month").over(Window.partitionBy("customer_id"))
    return months.withColumn("cohort_month", first).withColumn(
        "cohort_index", month_index(F.col("cohort_month"), F.col("invoice_month"))
    )


def cohort_counts(pur: DataFrame) -> DataFrame:
    """Customers per cohort and months since the first purchase, with the retained share."""
    counted = with_cohort(pur).groupBy("cohort_month", "cohort_index").agg(
        F.count(F.lit(1)).alias("customers")
    )
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return counted.withColumn("retention", F.col("customers") / size).orderBy(
        "cohort_month", "cohort_index"
    )


def cohort_retention(pur: DataFrame, months: int = 6, cohorts: int = 8) -> DataFrame:
    """The first cohorts' retention in percent, one column per month; no customers is NULL."""
    counts = cohort_counts(pur)
    wide = (
        counts.withColumn("pct", F.col("retention") * 100)
        .groupBy("cohort_month")
        .pivot("cohort_index", list(range(months)))
        .agg(F.first("pct"))
    )
    named = wide.withColumnsRenamed({str(i): f"month_{i}" for i in range(months)})
    return named.orderBy("cohort_month").limit(cohorts)

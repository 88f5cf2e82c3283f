"""The customer base: one row per purchaser, with value bins and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.calendar import elapsed_days, midnight, month_text
from ebbtide.functions.scalars import (
    country_group, cut, label_at, quantile_bin, rank_bin, rfm_code, rfm_segment,
)
from ebbtide.operators.grains import Distinct, Total, by_grains, holds
from ebbtide.operators.ordering import ranked
from ebbtide.operators.quality import is_purchase, is_return
from ebbtide.operators.summaries import quantile_values
from ebbtide.runtime import materialized, one_row, resolved_row


def _when(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def purchase_totals(where: Column | None = None) -> tuple[dict[str, Total], dict[str, Distinct]]:
    """Purchase aggregates of one customer over the rows that meet ``where``: totals of invoices, and distinct counts."""
    of = lambda name: _when(where, F.col(name))
    totals = {
        "first_purchase": Total(F.min(of("invoice_date")), F.min),
        "last_purchase": Total(F.max(of("invoice_date")), F.max),
        "purchase_lines": Total(F.count(of("invoice_no"))),
        "unique_invoices": holds(of("invoice_no").isNotNull()),
        "total_quantity": Total(F.sum(of("quantity"))),
        "total_spend": Total(F.sum(of("line_amount"))),
        "_prices": Total(F.sum(of("price"))),
        "_priced": Total(F.count(of("price"))),
    }
    return totals, {
        "distinct_products": Distinct(of("stock_code")),
        "days_active": Distinct(_when(where, midnight(F.col("invoice_date")))),
    }


def return_totals(where: Column | None = None) -> dict[str, Total]:
    return {
        "return_count": Total(F.count(_when(where, F.col("invoice_no")))),
        "return_value": Total(F.sum(_when(where, F.col("line_amount"))), lambda c: F.coalesce(F.sum(c), F.lit(0.0))),
    }


PURCHASE_COLUMNS = [
    "customer_id", "first_purchase", "last_purchase", "purchase_lines", "unique_invoices", "total_quantity",
    "total_spend", "avg_unit_price", "countries", "distinct_products", "days_active", "primary_country",
]


def countries(df: DataFrame, key: str) -> DataFrame:
    """Distinct countries and the most common one per key, from one count of (key, country)."""
    counted = df.filter(F.col("country").isNotNull()).groupBy(key, "country").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(
        F.count(F.lit(1)).alias("countries"), F.min(F.struct(-F.col("_n"), F.col("country"))).getField("country").alias("primary_country"))


def most_common(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most common non-NULL value per key, the smallest on ties.

    Counted per (key, value) first, so a key with many rows or many values stays spread out.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(
        F.min(F.struct(-F.col("_n"), F.col(value))).getField(value).alias(name)
    )


def _with_countries(totals: DataFrame, bought: DataFrame) -> DataFrame:
    return totals.join(countries(bought, "customer_id"), "customer_id", "left").withColumns({
        "countries": F.coalesce("countries", F.lit(0)), "avg_unit_price": F.try_divide("_prices", "_priced")})


def customer_purchases(pur: DataFrame) -> DataFrame:
    """Purchase aggregates and main country per customer."""
    totals, distinct = purchase_totals()
    return _with_countries(by_grains(pur, "customer_id", "invoice_no", totals, distinct), pur).select(*PURCHASE_COLUMNS)


def customer_returns(ret: DataFrame) -> DataFrame:
    return ret.groupBy("customer_id").agg(*[total.of.alias(name) for name, total in return_totals().items()]).withColumn(
        "return_value", F.coalesce("return_value", F.lit(0.0)))


def customer_totals(clean: DataFrame) -> DataFrame:
    """Purchase and return aggregates of every purchaser.

    A cancelled invoice with a positive quantity counts on both sides. Customers that only
    returned have no row.
    """
    bought, sent_back = is_purchase(), is_return()
    totals, distinct = purchase_totals(bought)
    found = by_grains(
        clean.filter(bought | sent_back), "customer_id", "invoice_no", {**totals, **return_totals(sent_back)}, distinct,
    ).filter(F.col("purchase_lines") > 0)
    return _with_countries(found, clean.filter(bought)).select(*PURCHASE_COLUMNS, "return_count", "return_value")


def with_ratios(totals: DataFrame) -> DataFrame:
    orders = F.col("unique_invoices")
    return totals.withColumns({
        "customer_tenure_days": elapsed_days(F.col("first_purchase"), F.col("last_purchase")),
        "net_spend": F.col("total_spend") + F.col("return_value"),
        "avg_basket_size": F.col("purchase_lines") / orders,
        "avg_order_value": F.col("total_spend") / orders,
        "return_rate": F.col("return_count") / orders,
        "first_purchase_month": month_text(F.col("first_purchase")),
        "country_group": country_group(F.col("primary_country")),
    })


def with_segments(totals: DataFrame, strict: bool = False) -> DataFrame:
    """Spend quartile, frequency segment and the RFM scores, code and segment.

    Frequency is scored by rank, ties in customer order; recency and spend by quartile edges.
    The customer rows are written once; the edges, the ranks and the result read them from there.
    """
    totals = materialized(totals)
    facts = resolved_row(
        totals.agg(F.count(F.lit(1)).alias("n"), F.max("last_purchase").alias("latest"))
    )
    spread = ranked(totals, ["unique_invoices", "customer_id"], "_frequency_rank")
    quartiles = [0.0, 0.25, 0.5, 0.75, 1.0]
    spend_edges = quantile_values(totals, "total_spend", quartiles)
    # day counts have few distinct values, so the built-in exact percentile is safe
    recency = elapsed_days(F.col("last_purchase"), facts["latest"])
    recency_edges = totals.agg(F.percentile(recency, quartiles)).first()[0] or []
    spend_bin = quantile_bin(F.col("total_spend"), spend_edges, strict)
    scored = spread.withColumn("recency_days", recency).withColumns({
        "frequency": F.col("unique_invoices"),
        "monetary": F.col("total_spend"),
        "r_score": (5 - quantile_bin(F.col("recency_days"), recency_edges, strict)).cast("int"),
        "f_score": rank_bin(F.col("_frequency_rank"), facts["n"]),
        "m_score": spend_bin,
    })
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.withColumns({
        "spend_quartile": label_at(m, fv.SPEND_QUARTILES),
        "frequency_segment": cut(F.col("unique_invoices"), fv.FREQUENCY_EDGES, fv.FREQUENCY_SEGMENTS),
        "rfm_score": rfm_code(r, f, m),
        "rfm_segment": rfm_segment(r, f, m, F.col("recency_days")),
    }).drop("_frequency_rank")


BASE_COLUMNS = [
    "customer_id", "first_purchase", "last_purchase", "purchase_lines", "unique_invoices",
    "total_quantity", "total_spend", "avg_unit_price", "countries", "distinct_products",
    "days_active", "primary_country", "return_count", "return_value", "customer_tenure_days",
    "net_spend", "avg_basket_size", "avg_order_value", "return_rate", "first_purchase_month",
    "country_group", "spend_quartile", "frequency_segment", "recency_days", "frequency",
    "monetary", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment",
]


def customer_base(clean: DataFrame, strict: bool = False) -> DataFrame:
    """The 31-column customer base from clean transactions."""
    return with_segments(with_ratios(customer_totals(clean)), strict).select(*BASE_COLUMNS)


def _total(df: DataFrame, column: str) -> Column:
    return df.agg(F.sum(column).alias("total")).scalar()


def spend_quartile_summary(base: DataFrame) -> DataFrame:
    return (
        base.groupBy("spend_quartile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("total_spend").alias("avg_spend"),
            F.avg("unique_invoices").alias("avg_orders"),
            F.sum("total_spend").alias("_spend"),
        )
        .withColumn("pct_of_total_revenue", F.col("_spend") / _total(base, "total_spend") * 100)
        .drop("_spend")
        .orderBy("spend_quartile")
    )


def frequency_segment_summary(base: DataFrame) -> DataFrame:
    everyone = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        base.groupBy("frequency_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("total_spend").alias("avg_spend"),
        )
        .withColumn("pct_of_customers", F.col("customers") * 100.0 / everyone)
    )


def rfm_segment_summary(base: DataFrame) -> DataFrame:
    """Revenue, mean spend and customers per RFM segment, most revenue first."""
    return (
        base.groupBy("rfm_segment")
        .agg(
            F.sum("total_spend").alias("total_revenue"),
            F.avg("total_spend").alias("avg_spend"),
            F.count(F.lit(1)).alias("customer_count"),
        )
        .orderBy(F.desc("total_revenue"), "rfm_segment")
    )


def rfm_net_summary(base: DataFrame) -> DataFrame:
    """The same on net spend."""
    return (
        base.groupBy("rfm_segment")
        .agg(
            F.count("customer_id").alias("n_customers"),
            F.avg("net_spend").alias("avg_net_spend"),
            F.sum("net_spend").alias("total_net_spend"),
        )
        .orderBy(F.desc("total_net_spend"), "rfm_segment")
    )


def segment_profile(base: DataFrame, segment: str) -> DataFrame:
    """Customers, revenue share, and mean, median, min and max of the main metrics."""
    from ebbtide.operators.distributions import describe_numeric

    members = base.filter(F.col("rfm_segment") == segment)
    everyone = _total(base, "total_spend")
    facts = one_row(members.agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_spend").alias("spend"),
    ))
    metrics = ["recency_days", "frequency", "monetary", "customer_tenure_days"]
    return describe_numeric(members, metrics).select(
        F.lit(segment).alias("rfm_segment"),
        facts["n"].alias("customers"),
        (facts["spend"] / everyone * 100).alias("revenue_share_pct"),
        F.col("column").alias("metric"), "mean", F.col("p50").alias("median"), "min", "max",
    )


def segment_top_customers(base: DataFrame, segment: str, n: int = 200) -> DataFrame:
    return (
        base.filter(F.col("rfm_segment") == segment)
        .orderBy(F.desc("total_spend"), "customer_id")
        .limit(n)
    )


def stored_customer_base(clean: DataFrame) -> DataFrame:
    """The customer base written once, for reports that read it several times."""
    return materialized(customer_base(clean))

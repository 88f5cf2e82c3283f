"""Whole-run facts: headline metadata and column descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.concentration import gini
from ebbtide.operators.summaries import quantile_values
from ebbtide.operators.quality import cleaning_counts
from ebbtide.runtime import one_row

#: The rule that makes each column; p: purchase lines, r: return lines, ref: the reference date.
DESCRIPTIONS = {
    "customer_id": "key, canonical text",
    "first_purchase": "min(p.invoice_date)",
    "last_purchase": "max(p.invoice_date)",
    "first_purchase_date": "min(p.invoice_date)",
    "last_purchase_date": "max(p.invoice_date)",
    "purchase_lines": "count(p.invoice_no)",
    "unique_invoices": "count(distinct p.invoice_no)",
    "frequency_orders": "count(distinct p.invoice_no)",
    "total_quantity": "sum(p.quantity)",
    "total_spend": "sum(p.line_amount)",
    "monetary_total_spend": "sum(p.line_amount)",
    "avg_unit_price": "avg(price of p)",
    "max_unit_price": "max(price of p)",
    "countries": "count(distinct p.country)",
    "unique_countries": "count(distinct p.country)",
    "distinct_products": "count(distinct p.stock_code)",
    "unique_products": "count(distinct p.stock_code)",
    "unique_descriptions": "count(distinct p.description)",
    "days_active": "count(distinct date of p)",
    "distinct_active_days": "count(distinct date of p)",
    "active_months": "count(distinct month of p)",
    "primary_country": "mode(p.country), smallest on ties",
    "return_count": "count(r.invoice_no)",
    "return_lines": "count(r.invoice_no)",
    "return_invoices": "count(distinct r.invoice_no)",
    "returned_quantity": "sum(abs(r.quantity)), or of negative ones alone",
    "return_value": "sum(r.line_amount), by size in the feature tables",
    "customer_tenure_days": "floor(last - first) in days",
    "tenure_days": "floor(last - first) in days",
    "tenure_since_first": "date(ref) - date(first) in days",
    "net_spend": "spend with returns taken off",
    "avg_basket_size": "purchase_lines / unique_invoices",
    "avg_order_value": "spend / orders",
    "avg_qty_per_order": "total_quantity / orders",
    "return_rate": "return_count / unique_invoices",
    "return_invoice_ratio": "return_invoices / orders",
    "return_value_ratio": "return_value / spend, unbounded",
    "first_purchase_month": "yyyy-MM of first",
    "country_group": "group of primary_country",
    "spend_quartile": "label of m_score",
    "frequency_segment": "label of orders, cut at 1, 3, 10",
    "recency_days": "ref - last in days",
    "frequency": "unique_invoices",
    "monetary": "total_spend",
    "r_score": "5 - quartile(recency_days)",
    "f_score": "quartile(rank of orders)",
    "m_score": "quartile(total_spend)",
    "rfm_score": "100 r + 10 f + m",
    "rfm_segment": "label of r, f, m",
    "is_one_time_buyer": "orders = 1",
    "purchase_frequency_rate": "orders / tenure_since_first",
    "recency_to_tenure_ratio": "recency_days / tenure_since_first",
    "avg_gap_days": "avg(gap), tenure_since_first without gaps",
    "median_gap_days": "median(gap), tenure_since_first without gaps",
    "max_gap_days": "max(gap), tenure_since_first without gaps",
    "snapshot_date": "ref",
    "future_orders": "count(distinct invoice_no after ref, up to the label end)",
    "churn_label": "future_orders = 0",
}


def run_metadata(tx: DataFrame, base: DataFrame, analysis_time: Column | None = None) -> DataFrame:
    """Headline facts of a run as text rows ``(Metric, Value)``."""
    counts = one_row(cleaning_counts(tx))
    raw = one_row(tx.agg(
        F.min("invoice_date").alias("lo"), F.max("invoice_date").alias("hi"),
        F.count_distinct("country").alias("countries"),
    ))
    customers = one_row(base.agg(
        F.count(F.lit(1)).alias("customers"), F.max("last_purchase").alias("latest"),
        F.sum("total_spend").alias("gross"), F.sum("net_spend").alias("net"),
        F.avg("net_spend").alias("mean_net"), F.count_distinct("rfm_segment").alias("segments"),
    ))
    median_net = F.lit(quantile_values(base, "net_spend", [0.5])[0]).cast("double")
    gini_spend = gini(base, "total_spend").select("gini").scalar()
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    money = lambda c: F.format_number(c, 2)
    now = F.current_timestamp() if analysis_time is None else analysis_time
    facts = [
        ("Analysis Date", F.date_format(now, "yyyy-MM-dd HH:mm:ss")),
        ("Data Period", F.concat(day(raw["lo"]), F.lit(" to "), day(raw["hi"]))),
        ("Observation Date (for churn window)", day(customers["latest"])),
        ("Raw Records", counts["raw"].cast("string")),
        ("Cleaned Records", counts["clean"].cast("string")),
        ("Purchase Records", counts["purchase"].cast("string")),
        ("Return / Cancellation Records", counts["returned"].cast("string")),
        ("Special Stock-Code Rows Removed", counts["special_removed"].cast("string")),
        ("Total Customers", customers["customers"].cast("string")),
        ("Gross Revenue (£)", money(customers["gross"])),
        ("Net Revenue after Returns (£)", money(customers["net"])),
        ("Avg Customer Net Spend (£)", money(customers["mean_net"])),
        ("Median Customer Net Spend (£)", money(median_net)),
        ("Unique Countries", raw["countries"].cast("string")),
        ("Customer Gini Coefficient", F.format_number(gini_spend, 3)),
        ("RFM Segments Identified", customers["segments"].cast("string")),
    ]
    stacked = F.array(*[F.struct(F.lit(name).alias("Metric"), value.alias("Value")) for name, value in facts])
    return tx.sparkSession.range(1).select(F.inline(stacked))

"""Per-customer features: over the full history, or inside an observation window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.calendar import calendar_days, elapsed_days, midnight, month_text, plus_days
from ebbtide.functions.scalars import as_flag, safe_ratio
from ebbtide.operators.gaps import fill_gaps, gap_features, purchase_gaps
from ebbtide.operators.grains import Distinct, Total, by_grains, holds
from ebbtide.operators.quality import is_purchase, is_return

PRICE = "unit_price"


def _at(where: Column, value: Column) -> Column:
    return F.when(where, value)


def rfm_totals(bought: Column) -> dict[str, Total]:
    """Recency, frequency and spend aggregates over the purchase rows."""
    of = lambda name: _at(bought, F.col(name))
    return {
        "first_purchase": Total(F.min(of("invoice_date")), F.min),
        "last_purchase": Total(F.max(of("invoice_date")), F.max),
        "frequency_orders": holds(of("invoice_no").isNotNull()),
        "purchase_lines": Total(F.count(of("invoice_no"))),
        "monetary_total_spend": Total(F.sum(of("line_amount"))),
        "total_quantity": Total(F.sum(of("quantity"))),
    }


def mix_totals(bought: Column) -> tuple[dict[str, Total], dict[str, Distinct]]:
    """Breadth of products, countries, prices and dates over the purchase rows."""
    of = lambda name: _at(bought, F.col(name))
    prices = {
        "_prices": Total(F.sum(of(PRICE))), "_priced": Total(F.count(of(PRICE))), "max_unit_price": Total(F.max(of(PRICE)), F.max),
    }
    return prices, {
        "unique_products": Distinct(of("stock_code")),
        "unique_countries": Distinct(of("country")),
        "distinct_active_days": Distinct(_at(bought, midnight(F.col("invoice_date"))), ("active_months", month_text)),
    }


def return_totals(sent_back: Column, negatives_only: bool) -> dict[str, Total]:
    """Return aggregates. ``negatives_only`` adds up negative quantities and amounts;
    otherwise every return row counts by its absolute value."""
    size = lambda c: F.when(F.col(c) < 0, -F.col(c)) if negatives_only else F.abs(c)
    total = lambda c: Total(F.sum(_at(sent_back, size(c))), lambda name: F.coalesce(F.sum(name).cast("double"), F.lit(0.0)))
    return {
        "return_lines": Total(F.count(_at(sent_back, F.col("invoice_no")))),
        "return_invoices": holds(_at(sent_back, F.col("invoice_no")).isNotNull()),
        "returned_quantity": total("quantity"),
        "return_value": total("line_amount"),
    }


def _per_customer(lines: DataFrame, totals: dict[str, Total], distinct: dict[str, Distinct] | None = None) -> DataFrame:
    """One row per customer with an id, from the invoice grain and the pairs to count."""
    named = lines.filter(F.col("customer_id").isNotNull())
    found = by_grains(named, "customer_id", "invoice_no", totals, distinct or {})
    if "_prices" in totals:
        found = found.withColumn("avg_unit_price", F.try_divide("_prices", "_priced")).drop("_prices", "_priced")
    return found


def with_rfm_ratios(totals: DataFrame, snapshot: Column) -> DataFrame:
    first, last, orders = F.col("first_purchase"), F.col("last_purchase"), F.col("frequency_orders")
    aged = totals.withColumns({
        "recency_days": calendar_days(last, snapshot),
        "tenure_days": elapsed_days(first, last),
        "tenure_since_first": calendar_days(first, snapshot),
    })
    age = F.col("tenure_since_first")
    return aged.withColumns({
        "avg_order_value": safe_ratio(F.col("monetary_total_spend"), orders),
        "avg_qty_per_order": safe_ratio(F.col("total_quantity"), orders),
        "is_one_time_buyer": as_flag(orders == 1),
        "purchase_frequency_rate": safe_ratio(orders, age),
        "recency_to_tenure_ratio": safe_ratio(F.col("recency_days"), age),
    })


def with_return_ratios(totals: DataFrame, zero: str) -> DataFrame:
    """Net spend and return intensity; the ratios may exceed 1."""
    spend, value = F.col("monetary_total_spend"), F.col("return_value")
    return totals.withColumns({
        "net_spend": spend - value,
        "return_invoice_ratio": safe_ratio(F.col("return_invoices"), F.col("frequency_orders")),
        "return_value_ratio": safe_ratio(value, spend, zero),
    })


def descriptive_snapshot(observation_date: Column) -> Column:
    """Midnight after the observation date, so the latest buyer has a recency of 1."""
    return plus_days(midnight(observation_date), 1)


def rfm_features(pur: DataFrame, snapshot: Column) -> DataFrame:
    return with_rfm_ratios(_per_customer(pur, rfm_totals(F.lit(True))), snapshot)


def mix_features(pur: DataFrame) -> DataFrame:
    prices, distinct = mix_totals(F.lit(True))
    return _per_customer(pur, prices, {**distinct, "unique_descriptions": Distinct(F.col("description"))})


def return_features(ret: DataFrame, negatives_only: bool = True) -> DataFrame:
    return _per_customer(ret, return_totals(F.lit(True), negatives_only))


FEATURE_COLUMNS = [
    "customer_id", "last_purchase_date", "first_purchase_date", "frequency_orders",
    "purchase_lines", "monetary_total_spend", "total_quantity", "recency_days", "tenure_days",
    "tenure_since_first", "avg_order_value", "avg_qty_per_order", "is_one_time_buyer",
    "purchase_frequency_rate", "recency_to_tenure_ratio", "return_lines", "return_invoices",
    "returned_quantity", "return_value", "net_spend", "return_invoice_ratio",
    "return_value_ratio", "unique_products", "unique_descriptions", "unique_countries",
    "avg_unit_price", "max_unit_price", "distinct_active_days", "active_months",
    "avg_gap_days", "median_gap_days", "max_gap_days", "snapshot_date",
]


def customer_features(clean: DataFrame, snapshot: Column) -> DataFrame:
    """The 33-column descriptive table over the full history.

    Invoices carry purchases and returns, tables of pairs the product mix; the gaps are a narrow aggregation.
    All are keyed on the customer, so their join needs no further shuffle.
    """
    bought, sent_back = is_purchase("positive", PRICE), is_return("any_price", PRICE)
    prices, distinct = mix_totals(bought)
    totals = _per_customer(
        clean.filter(bought | sent_back), {**rfm_totals(bought), **prices, **return_totals(sent_back, negatives_only=True)},
        {**distinct, "unique_descriptions": Distinct(_at(bought, F.col("description")))},
    ).filter(F.col("purchase_lines") > 0)
    gaps = gap_features(purchase_gaps(clean.filter(bought), "timestamp"))
    wide = with_return_ratios(with_rfm_ratios(totals, snapshot), "null_to_zero")
    return (
        fill_gaps(wide.join(gaps, "customer_id", "left"), F.col("tenure_since_first"))
        .withColumn("snapshot_date", snapshot)
        .withColumnsRenamed({"first_purchase": "first_purchase_date", "last_purchase": "last_purchase_date"})
        .select(*FEATURE_COLUMNS)
    )


WINDOW_FEATURE_COLUMNS = [
    "customer_id", "first_purchase", "last_purchase", "frequency_orders", "purchase_lines",
    "monetary_total_spend", "total_quantity", "unique_products", "unique_countries",
    "avg_unit_price", "max_unit_price", "recency_days", "tenure_days", "tenure_since_first",
    "avg_order_value", "avg_qty_per_order", "is_one_time_buyer", "purchase_frequency_rate",
    "recency_to_tenure_ratio", "distinct_active_days", "active_months", "avg_gap_days",
    "median_gap_days", "max_gap_days", "return_lines", "return_invoices", "returned_quantity",
    "return_value", "net_spend", "return_invoice_ratio", "return_value_ratio",
]


def window_features(
    clean: DataFrame, obs_start: Column, snapshot: Column, future: dict[str, Total] | None = None
) -> DataFrame:
    """Features from what happened between ``obs_start`` and ``snapshot``, both included.

    ``future`` may add totals over other rows of the same customers' invoices, so that a label can be
    computed in the same pass.
    """
    ts = F.col("invoice_date")
    seen = (ts >= obs_start) & (ts <= snapshot)
    bought = is_purchase("not_return", PRICE) & seen
    sent_back = is_return("any_price", PRICE) & seen
    prices, distinct = mix_totals(bought)
    lines = clean if future else clean.filter(seen)
    totals = _per_customer(
        lines, {**rfm_totals(bought), **prices, **return_totals(sent_back, negatives_only=False), **(future or {})}, distinct,
    ).filter(F.col("purchase_lines") > 0)
    gaps = gap_features(purchase_gaps(clean.filter(bought), "day"))
    wide = with_return_ratios(with_rfm_ratios(totals, snapshot), "tiny")
    return fill_gaps(wide.join(gaps, "customer_id", "left"), F.col("tenure_since_first")).select(
        *WINDOW_FEATURE_COLUMNS, *(future or {})
    )

"""Gaps, features, churn definition and labelling."""

from pyspark.sql import functions as F

from ebbtide.operators import churn, features, gaps, quality
from ebbtide.plans.reporting import DESCRIPTIONS
from ebbtide.runtime import materialized
from ebbtide.sources.sinks import data_dictionary
from ebbtide.sources.transactions import resolve_observation_date
from registry.core import dictionary_sql, events, pur, r, register, stable, stored_clean, stored_unit



def stored_sold(spark, folder):
    """Purchase lines as the churn steps define them."""
    return quality.purchases(stored_unit(spark, folder), "not_return", features.PRICE)


def stored_bought(spark, folder):
    return quality.purchases(stored_unit(spark, folder), "positive", features.PRICE)


def stored_events(spark, folder):
    """What the gaps need of the purchase lines, written once: an order over them passes them several times."""
    return materialized(gaps.purchase_events(pur(spark, folder), "invoice")).withColumnRenamed("purchased_at", "invoice_date")


@register("purchase_gaps_invoice", "SELECT customer_id, invoice_no, purchased_at, previous_at, gap_days FROM invgap")
def _(spark, folder):
    return gaps.purchase_gaps(stored_events(spark, folder), "invoice")


@register("purchase_gaps_timestamp", "SELECT customer_id, purchased_at, previous_at, gap_days FROM tsgap")
def _(spark, folder):
    return gaps.purchase_gaps(stored_events(spark, folder), "timestamp")


@register("purchase_gaps_day", "SELECT customer_id, purchased_at, previous_at, gap_days FROM daygap")
def _(spark, folder):
    return gaps.purchase_gaps(stored_sold(spark, folder), "day")


@register("purchase_gaps_events", "SELECT customer_id, purchased_at, previous_at, gap_days FROM evgap")
def _(spark, folder):
    return gaps.purchase_gaps(events(spark, folder), "timestamp")


GAP_SUMMARY = """count(*) AS gaps, count(DISTINCT customer_id) AS repeat_customers, {mean} AS mean, {std} AS std,
  min(gap_days) AS min, {p50} AS p50, {p75} AS p75, {p90} AS p90, {p95} AS p95, {p99} AS p99,
  max(gap_days) AS max""".format(
    mean=r("avg(gap_days)"), std=r("stddev_samp(gap_days)"),
    **{f"p{p}": r(f"quantile_cont(gap_days, 0.{p})") for p in (50, 75, 90, 95, 99)})


@register("gap_summary", f"SELECT {GAP_SUMMARY} FROM daygap")
def _(spark, folder):
    return stable(gaps.gap_summary(gaps.purchase_gaps(stored_sold(spark, folder), "day")))


@register("gap_summary_events", f"SELECT {GAP_SUMMARY} FROM evgap")
def _(spark, folder):
    return stable(gaps.gap_summary(gaps.purchase_gaps(events(spark, folder), "timestamp")))


@register("gap_features", f"""
  SELECT customer_id, {r('a')} AS avg_gap_days, {r('m')} AS median_gap_days, {r('x')} AS max_gap_days FROM dgap""")
def _(spark, folder):
    return stable(gaps.gap_features(gaps.purchase_gaps(pur(spark, folder), "timestamp")))


def _select(names, rounded, places=4):
    return ", ".join(f"{r(c, places)} AS {c}" if c in rounded else c for c in names)


DOUBLES = {
    "monetary_total_spend", "avg_order_value", "avg_qty_per_order", "purchase_frequency_rate",
    "recency_to_tenure_ratio", "returned_quantity", "return_value", "net_spend", "return_invoice_ratio",
    "return_value_ratio", "avg_unit_price", "max_unit_price", "avg_gap_days", "median_gap_days", "max_gap_days",
}


def snapshot(purchases):
    return features.descriptive_snapshot(resolve_observation_date(purchases))


RFM = ["customer_id", "frequency_orders", "purchase_lines", "monetary_total_spend", "total_quantity",
       "recency_days", "tenure_days", "tenure_since_first", "avg_order_value", "avg_qty_per_order",
       "is_one_time_buyer", "purchase_frequency_rate", "recency_to_tenure_ratio"]


@register("rfm_features", f"""
  SELECT {_select(RFM, DOUBLES)}, first_purchase_date AS first_purchase, last_purchase_date AS last_purchase
  FROM described""")
def _(spark, folder):
    bought = stored_bought(spark, folder)
    return stable(features.rfm_features(bought, snapshot(bought)))


@register("return_features", f"""
  SELECT customer_id, l AS return_lines, i AS return_invoices, {r('q')} AS returned_quantity,
    {r('v')} AS return_value FROM dret""")
def _(spark, folder):
    return stable(features.return_features(quality.returns(stored_unit(spark, folder), "any_price", features.PRICE)))


MIX = ["customer_id", "unique_products", "unique_descriptions", "unique_countries", "avg_unit_price",
       "max_unit_price", "distinct_active_days", "active_months"]


@register("mix_features", f"SELECT {_select(MIX, DOUBLES)} FROM dtot")
def _(spark, folder):
    return stable(features.mix_features(stored_bought(spark, folder)))


@register("customer_features", f"SELECT {_select(features.FEATURE_COLUMNS, DOUBLES)} FROM described")
def _(spark, folder):
    return stable(customer_features(spark, folder))


def customer_features(spark, folder):
    table = stored_unit(spark, folder)
    return features.customer_features(table, snapshot(quality.purchases(table, "positive", features.PRICE)))


@register("one_time_buyer_share", f"""
  SELECT {r('avg(is_one_time_buyer)', 6)} AS one_time_share FROM described""")
def _(spark, folder):
    table = customer_features(spark, folder)
    return stable(quality.share(table, F.col("is_one_time_buyer") == 1, "one_time_share"), 6)


# ---------------------------------------------------------------- churn definition

@register("churn_threshold", f"SELECT {r('gap_quantile')} AS gap_quantile, threshold_days FROM thr")
def _(spark, folder):
    sold = stored_sold(spark, folder)
    return stable(churn.churn_threshold(gaps.purchase_gaps(sold, "day")))


@register("churn_threshold_events", f"""
  SELECT {r('q')} AS gap_quantile, CAST(least(greatest(round_even(q, 0), 1), 30) AS INTEGER) AS threshold_days
  FROM (SELECT quantile_cont(gap_days, 0.9) AS q FROM evgap)""")
def _(spark, folder):
    found = gaps.purchase_gaps(events(spark, folder), "timestamp")
    return stable(churn.churn_threshold(found, step=1, lo=1, hi=30))


@register("churn_windows", "SELECT obs_start, snapshot, label_end, threshold_days FROM win")
def _(spark, folder):
    sold = stored_sold(spark, folder)
    threshold = churn.churn_threshold(gaps.purchase_gaps(sold, "day"))
    return churn.window_table(sold, threshold.select("threshold_days").scalar())


@register("window_features", f"SELECT {_select(features.WINDOW_FEATURE_COLUMNS, DOUBLES)} FROM feat")
def _(spark, folder):
    table = stored_unit(spark, folder)
    windows = churn.derived_windows(table)
    return stable(features.window_features(table, windows.obs_start, windows.snapshot))


MODEL = [*features.WINDOW_FEATURE_COLUMNS, "snapshot_date", "future_orders", "churn_label"]


def modeling_dataset(spark, folder):
    table = stored_unit(spark, folder)
    return churn.modeling_dataset(table, churn.derived_windows(table))


def stored_model_table(spark, folder):
    return materialized(modeling_dataset(spark, folder))


@register("modeling_dataset", f"SELECT {_select(MODEL, DOUBLES)} FROM model")
def _(spark, folder):
    return stable(modeling_dataset(spark, folder))


@register("labelled_customers", "SELECT customer_id, future_orders, churn_label FROM model")
def _(spark, folder):
    table = stored_unit(spark, folder)
    windows = churn.derived_windows(table)
    known = features.window_features(table, windows.obs_start, windows.snapshot)
    return churn.label_churn(known, quality.purchases(table, "not_return", features.PRICE), windows).select(
        "customer_id", "future_orders", "churn_label"
    )


@register("class_balance", "SELECT churn_label, count(*) AS count FROM model GROUP BY 1")
def _(spark, folder):
    return churn.class_balance(modeling_dataset(spark, folder))


@register("churn_by_recency", f"""
  SELECT CASE WHEN recency_days <= 30 THEN '0-30' WHEN recency_days <= 60 THEN '31-60'
      WHEN recency_days <= 90 THEN '61-90' WHEN recency_days <= 120 THEN '91-120'
      WHEN recency_days <= 180 THEN '121-180' ELSE '180+' END AS recency_bucket,
    {r('avg(churn_label)', 6)} AS churn_rate FROM model GROUP BY 1""")
def _(spark, folder):
    return stable(churn.churn_by_recency(modeling_dataset(spark, folder)), 6)


CURVE = """
  SELECT CAST(t AS INTEGER) AS threshold_days, count(*) FILTER (first <= snap) AS n_eligible,
    count(*) FILTER (last <= snap) AS n_churned,
    round(count(*) FILTER (last <= snap) / nullif(count(*) FILTER (first <= snap), 0), 4) AS churn_rate
  FROM (SELECT customer_id, min(invoice_date) AS first, max(invoice_date) AS last FROM sold GROUP BY 1),
    (SELECT t, CAST(CAST((SELECT max(invoice_date) FROM sold) - to_days(CAST(t AS INTEGER)) AS DATE) AS TIMESTAMP) AS snap
     FROM range(30, 181, 5) g(t)) GROUP BY t"""


@register("churn_rate_curve", CURVE)
def _(spark, folder):
    return churn.churn_rate_curve(stored_sold(spark, folder))


@register("churn_rate_at_120_days", f"SELECT * FROM ({CURVE}) WHERE threshold_days = 120")
def _(spark, folder):
    curve = churn.churn_rate_curve(stored_sold(spark, folder))
    return churn.at_value(curve, "threshold_days", 120)


@register("customer_features_dictionary", dictionary_sql(features.FEATURE_COLUMNS, DESCRIPTIONS, "described"))
def _(spark, folder):
    return data_dictionary(customer_features(spark, folder), DESCRIPTIONS)


@register("modeling_dictionary", dictionary_sql(MODEL, DESCRIPTIONS, "model"))
def _(spark, folder):
    return data_dictionary(modeling_dataset(spark, folder), DESCRIPTIONS)


@register("observation_date", "SELECT max(invoice_date) AS observation_date FROM pur")
def _(spark, folder):
    bought = quality.purchases(stored_clean(spark, folder))
    return spark.range(1).select(resolve_observation_date(bought).alias("observation_date"))

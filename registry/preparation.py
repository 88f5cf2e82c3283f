"""Ingest, quality, cleaning, customer base and returns."""

from pyspark.sql import functions as F

from ebbtide.functions.calendar import calendar_parts, midnight
from ebbtide.functions.scalars import flag_rows, round_columns
from ebbtide.operators import customers, quality, returns
from ebbtide.plans.reporting import DESCRIPTIONS, run_metadata
from ebbtide.sources.sinks import data_dictionary, metrics_long
from registry.core import (
    SPECIAL, clean, day, dictionary_sql, month, pur, r, register, ret, stable, stored_clean, tx,
)

RAW = "invoice_no, stock_code, description, quantity, invoice_date, price, customer_id, country"


@register("normalized_transactions", f"SELECT {RAW}, {r('line_amount')} AS line_amount FROM raw")
def _(spark, folder):
    return stable(tx(spark, folder))


@register("row_flags", f"""
  SELECT starts_with(invoice_no, 'C') AS is_cancel_invoice, quantity < 0 AS is_negative_qty,
         price < 0 AS is_negative_price, {SPECIAL} AS is_special_stock, count(*) AS rows
  FROM raw GROUP BY ALL""")
def _(spark, folder):
    flags = ["is_cancel_invoice", "is_negative_qty", "is_negative_price", "is_special_stock"]
    return flag_rows(tx(spark, folder)).groupBy(*flags).agg(F.count(F.lit(1)).alias("rows"))


@register("calendar_parts", f"""
  SELECT {day('invoice_date')} AS day, strftime(invoice_date, '%Y-%m') AS month,
         {month('invoice_date')} AS month_start, dayname(invoice_date) AS weekday,
         CAST(hour(invoice_date) AS INTEGER) AS hour, count(*) AS lines FROM raw GROUP BY ALL""")
def _(spark, folder):
    parts = ["day", "month", "month_start", "weekday", "hour"]
    return calendar_parts(tx(spark, folder), "invoice_date").groupBy(*parts).agg(F.count(F.lit(1)).alias("lines"))


@register("quality_flags", f"""
  UNPIVOT (SELECT count(*) FILTER (starts_with(invoice_no, 'C')) AS cancel_invoice_rows,
    count(*) FILTER (quantity < 0) AS negative_qty_rows, count(*) FILTER (price < 0) AS negative_price_rows,
    count(*) FILTER (customer_id IS NULL) AS missing_customer_rows,
    count(*) FILTER (invoice_date IS NULL) AS missing_date_rows,
    count(*) FILTER ({SPECIAL}) AS special_stock_code_rows, count(*) FILTER (price = 0) AS zero_price_rows
    FROM raw) ON COLUMNS(*) INTO NAME flag VALUE count""")
def _(spark, folder):
    return quality.quality_flags(tx(spark, folder))


def _per_raw_column(expression: str) -> str:
    names = RAW.split(", ") + ["line_amount"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {expression.format(c=c)} FROM raw" for c in names
    )


@register("missing_pct", "SELECT * FROM (" + _per_raw_column(
    "round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 2) AS missing_pct") + ")")
def _(spark, folder):
    return quality.missing_pct(tx(spark, folder))


@register("missing_columns", "SELECT * FROM (" + _per_raw_column(
    "round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 2) AS missing_pct") + ") WHERE missing_pct > 0")
def _(spark, folder):
    return quality.missing_pct(tx(spark, folder), above_zero=True)


@register("column_profile", "SELECT * FROM (" + _per_raw_column(
    "count({c}) AS non_null, CASE lower(any_value(typeof({c}))) WHEN 'varchar' THEN 'string' "
    "WHEN 'integer' THEN 'int' WHEN 'timestamp' THEN 'timestamp_ntz' ELSE 'double' END AS dtype") + ")")
def _(spark, folder):
    return quality.column_profile(tx(spark, folder))


@register("basic_profile", """
  SELECT count(*) AS rows, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
    count(DISTINCT customer_id) AS customers, count(DISTINCT invoice_no) AS invoices FROM raw""")
def _(spark, folder):
    return quality.basic_profile(tx(spark, folder))


@register("distinct_counts", "SELECT " + ", ".join(
    f"count(DISTINCT {c}) AS {c}" for c in ("stock_code", "description", "country", "customer_id")) + " FROM raw")
def _(spark, folder):
    return quality.distinct_counts(tx(spark, folder), ["stock_code", "description", "country", "customer_id"])


@register("distinct_counts_approximate")
def _(spark, folder):
    names = ["stock_code", "description", "country", "customer_id"]
    return quality.distinct_counts(tx(spark, folder), names, approximate=True)


@register("duplicate_rows", """
  SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS duplicate_rows""")
def _(spark, folder):
    return quality.duplicate_count(tx(spark, folder))


COUNTS = f"""(SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM uniq) AS distinct_rows,
  (SELECT count(*) FROM raw WHERE customer_id IS NULL) AS no_customer,
  (SELECT count(*) FROM raw WHERE invoice_date IS NULL) AS no_date,
  (SELECT count(*) FROM uniq WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL) AS keyed,
  (SELECT count(*) FROM clean) AS clean_rows, (SELECT count(*) FROM pur) AS bought,
  (SELECT count(*) FROM ret) AS returned)"""


@register("cleaning_waterfall", f"""
  SELECT step, stage, rows, rows_by_subtraction, round(rows * 100.0 / raw_rows, 1) AS pct_of_raw FROM (
    SELECT raw_rows, unnest([1, 2, 3, 4, 5]) AS step,
      unnest(['Raw', 'After dedupe', 'After drop missing customer_id / date', 'After remove special stock codes',
              'After keep only positive qty & price']) AS stage,
      unnest([raw_rows, distinct_rows, keyed, clean_rows, bought]) AS rows,
      unnest([raw_rows, distinct_rows, distinct_rows - no_customer - no_date, clean_rows, bought]) AS rows_by_subtraction
    FROM {COUNTS})""")
def _(spark, folder):
    return quality.cleaning_waterfall(tx(spark, folder))


@register("validation_report", f"""
  SELECT unnest(['Exact duplicates removed', 'Rows with missing customer_id removed',
      'Rows with missing invoice_date removed', 'Special / non-product stock codes removed',
      'Non-positive quantity/price excluded', 'Rows retained in cleaned set', 'Rows retained in purchase set',
      'Return / cancellation rows tracked separately']) AS "check",
    unnest([raw_rows - distinct_rows, no_customer, no_date, keyed - clean_rows, raw_rows - bought, clean_rows,
      bought, returned]) AS count,
    unnest(['Removed', 'Removed', 'Removed', 'Removed', 'Removed', 'Retained', 'Retained', 'Tracked separately']) AS status
  FROM {COUNTS}""")
def _(spark, folder):
    return quality.validation_report(tx(spark, folder))


@register("special_code_profile", f"""
  SELECT trim(stock_code) AS stock_code, count(*) AS rows, {r('sum(line_amount)', 2)} AS revenue,
         coalesce(min(description), '') AS sample_description
  FROM raw WHERE {SPECIAL} GROUP BY 1 ORDER BY rows DESC, 1 LIMIT 20""")
def _(spark, folder):
    return stable(quality.special_code_profile(tx(spark, folder)), 2)


@register("special_code_share", f"""
  SELECT count(*) FILTER ({SPECIAL}) AS special_rows, {r(f'avg(CAST({SPECIAL} AS INTEGER)) * 100')} AS special_pct,
         {r(f'sum(line_amount) FILTER ({SPECIAL})', 2)} AS special_value FROM raw""")
def _(spark, folder):
    return stable(quality.special_code_share(tx(spark, folder)), special_value=2)


@register("clean_transactions", f"SELECT {RAW}, {r('line_amount')} AS line_amount FROM clean")
def _(spark, folder):
    return stable(clean(spark, folder))


@register("purchase_lines", f"SELECT {RAW}, {r('line_amount')} AS line_amount FROM pur")
def _(spark, folder):
    return stable(pur(spark, folder))


@register("return_lines", f"SELECT {RAW}, {r('line_amount')} AS line_amount FROM ret")
def _(spark, folder):
    return stable(ret(spark, folder))


@register("split_rules", """
  SELECT count(*) FILTER (quantity > 0 AND price > 0) AS purchase_positive,
    count(*) FILTER (NOT (quantity < 0 OR starts_with(invoice_no, 'C')) AND price > 0) AS purchase_not_return,
    count(*) FILTER ((quantity < 0 OR starts_with(invoice_no, 'C')) AND price > 0) AS return_priced,
    count(*) FILTER (quantity < 0 OR starts_with(invoice_no, 'C')) AS return_any_price,
    count(*) FILTER (quantity < 0 OR price < 0 OR starts_with(invoice_no, 'C')) AS return_or_negative_price
  FROM clean""")
def _(spark, folder):
    return clean(spark, folder).agg(
        *[F.count_if(quality.is_purchase(x)).alias(f"purchase_{x}") for x in ("positive", "not_return")],
        *[F.count_if(quality.is_return(x)).alias(f"return_{x}") for x in ("priced", "any_price", "or_negative_price")],
    )


@register("half_year_lines", """
  SELECT invoice_no, stock_code, invoice_date, quantity FROM clean
  WHERE invoice_date >= TIMESTAMP '1996-01-01' AND invoice_date <= TIMESTAMP '1996-06-30 23:59:59'""")
def _(spark, folder):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    return quality.in_window(
        clean(spark, folder), "invoice_date", at("1996-01-01"), at("1996-06-30 23:59:59")
    ).select("invoice_no", "stock_code", "invoice_date", "quantity")


@register("zero_price_share", f"SELECT {r('avg(CAST(price = 0 AS INTEGER))', 6)} AS zero_price_share FROM raw")
def _(spark, folder):
    return stable(quality.share(tx(spark, folder), F.col("price") == 0, "zero_price_share"), 6)


# ---------------------------------------------------------------- customer base

PURCHASE_TOTALS = f"""customer_id, first_purchase, last_purchase, purchase_lines, unique_invoices, total_quantity,
  {r('total_spend')} AS total_spend, {r('avg_unit_price')} AS avg_unit_price, countries, distinct_products,
  days_active, primary_country"""

BASE = f"""{PURCHASE_TOTALS}, return_count, {r('return_value')} AS return_value, customer_tenure_days,
  {r('net_spend')} AS net_spend, {r('avg_basket_size')} AS avg_basket_size,
  {r('avg_order_value')} AS avg_order_value, {r('return_rate')} AS return_rate, first_purchase_month,
  country_group, spend_quartile, frequency_segment, recency_days, frequency, {r('monetary')} AS monetary,
  r_score, f_score, m_score, rfm_score, rfm_segment"""


def base(spark, folder):
    return customers.stored_customer_base(stored_clean(spark, folder))


@register("customer_purchases", f"SELECT {PURCHASE_TOTALS} FROM ctot JOIN prim USING (customer_id)")
def _(spark, folder):
    return stable(customers.customer_purchases(quality.purchases(stored_clean(spark, folder))))


@register("customer_returns", f"""
  SELECT customer_id, return_count, {r('return_value')} AS return_value FROM rtot""")
def _(spark, folder):
    return stable(customers.customer_returns(ret(spark, folder)))


@register("customer_base", f"SELECT {BASE} FROM base")
def _(spark, folder):
    return stable(customers.customer_base(stored_clean(spark, folder)))


@register("spend_quartiles", f"""
  SELECT spend_quartile, count(*) AS customers, {r('avg(total_spend)')} AS avg_spend,
    {r('avg(unique_invoices)')} AS avg_orders,
    {r('sum(total_spend) / (SELECT sum(total_spend) FROM base) * 100')} AS pct_of_total_revenue
  FROM base GROUP BY spend_quartile""")
def _(spark, folder):
    return stable(customers.spend_quartile_summary(base(spark, folder)))


@register("frequency_segments", f"""
  SELECT frequency_segment, count(*) AS customers, {r('avg(total_spend)')} AS avg_spend,
    {r('count(*) * 100.0 / (SELECT count(*) FROM base)')} AS pct_of_customers
  FROM base GROUP BY frequency_segment""")
def _(spark, folder):
    return stable(customers.frequency_segment_summary(base(spark, folder)))


@register("rfm_segments", f"""
  SELECT rfm_segment, {r('sum(total_spend)', 2)} AS total_revenue, {r('avg(total_spend)', 2)} AS avg_spend,
    count(*) AS customer_count FROM base GROUP BY rfm_segment""")
def _(spark, folder):
    return stable(customers.rfm_segment_summary(base(spark, folder)), 2)


@register("rfm_net_segments", f"""
  SELECT rfm_segment, count(*) AS n_customers, {r('avg(net_spend)', 2)} AS avg_net_spend,
    {r('sum(net_spend)', 2)} AS total_net_spend FROM base GROUP BY rfm_segment""")
def _(spark, folder):
    return stable(customers.rfm_net_summary(base(spark, folder)), 2)


def _profile(metric: str) -> str:
    return f"""SELECT 'Champions' AS rfm_segment, count(*) AS customers,
      {r('sum(total_spend) / (SELECT sum(total_spend) FROM base) * 100')} AS revenue_share_pct,
      '{metric}' AS metric, {r(f'avg({metric})')} AS mean, {r(f'quantile_cont({metric}, 0.5)')} AS median,
      {r(f'min({metric})')} AS min, {r(f'max({metric})')} AS max FROM base WHERE rfm_segment = 'Champions'"""


@register("segment_profile", "SELECT * FROM (" + " UNION ALL ".join(
    map(_profile, ["recency_days", "frequency", "monetary", "customer_tenure_days"])) + ")")
def _(spark, folder):
    return stable(customers.segment_profile(base(spark, folder), "Champions"))


@register("segment_top_customers", f"""
  SELECT {BASE} FROM base WHERE rfm_segment = 'Champions' ORDER BY base.total_spend DESC, customer_id LIMIT 200""")
def _(spark, folder):
    return stable(customers.segment_top_customers(base(spark, folder), "Champions"))


# ---------------------------------------------------------------- returns

@register("return_reconciliation", f"""
  SELECT customer_id, stock_code, invoice_date, quantity, {r('line_amount')} AS line_amount, invoice_no,
    first_purchase_dt, matched_to_purchase FROM matched""")
def _(spark, folder):
    table = stored_clean(spark, folder)
    return stable(returns.reconcile_returns(quality.returns(table), quality.purchases(table)))


SUMMARY = f"""
  SELECT return_lines, matched_lines, unmatched_lines, returned_value, matched_value,
    coalesce(matched_lines * 100.0 / nullif(return_lines, 0), 0.0) AS matched_pct, gross_value,
    gross_value + returned_value AS net_value, abs(returned_value) * 100 / gross_value AS returned_pct_of_gross
  FROM (SELECT count(*) AS return_lines, count(*) FILTER (matched_to_purchase) AS matched_lines,
      count(*) FILTER (NOT matched_to_purchase) AS unmatched_lines, sum(line_amount) AS returned_value,
      coalesce(sum(line_amount) FILTER (matched_to_purchase), 0.0) AS matched_value,
      (SELECT sum(line_amount) FROM pur) AS gross_value FROM matched)"""


@register("reconciliation_summary", f"""
  SELECT return_lines, matched_lines, unmatched_lines, {r('returned_value', 2)} AS returned_value,
    {r('matched_value', 2)} AS matched_value, {r('matched_pct')} AS matched_pct, {r('gross_value', 2)} AS gross_value,
    {r('net_value', 2)} AS net_value, {r('returned_pct_of_gross')} AS returned_pct_of_gross FROM ({SUMMARY})""")
def _(spark, folder):
    table = stored_clean(spark, folder)
    summary = returns.reconciliation_summary(quality.returns(table), quality.purchases(table))
    return stable(summary, returned_value=2, matched_value=2, gross_value=2, net_value=2)


@register("reconciliation_report", f"""
  SELECT unnest(['Total return / cancellation lines', 'Matched to a prior purchase',
      'Unmatched (no prior purchase found)', 'Total value reversed (£, negative)',
      'Matched value reversed (£, negative)', 'Gross purchase value (£)', 'Net value after reconciliation (£)',
      'Return value as % of gross']) AS metric,
    unnest([format('{{:,}}', return_lines), format('{{:,}} ({{:.1f}}%)', matched_lines, matched_pct),
      format('{{:,}}', unmatched_lines), format('{{:,.2f}}', returned_value), format('{{:,.2f}}', matched_value),
      format('{{:,.2f}}', gross_value), format('{{:,.2f}}', net_value), format('{{:.2f}}%', returned_pct_of_gross)]) AS value
  FROM ({SUMMARY})""")
def _(spark, folder):
    table = stored_clean(spark, folder)
    summary = returns.reconciliation_summary(quality.returns(table), quality.purchases(table))
    return returns.reconciliation_report(summary)


def flagged(spark, folder):
    table = stored_clean(spark, folder)
    back = table.filter(quality.is_return("or_negative_price"))
    return returns.customers_with_return_flag(back, quality.purchases(table))


@register("customer_return_flags", f"""
  SELECT customer_id, {r('total_spend')} AS total_spend, total_orders, ever_returned FROM flagged""")
def _(spark, folder):
    return stable(flagged(spark, folder))


@register("returner_comparison", f"""
  SELECT CASE WHEN ever_returned THEN 'Returned at least once' ELSE 'No return' END AS ever_returned,
    count(*) AS customers, {r('avg(total_spend)')} AS avg_spend, {r('avg(total_orders)')} AS avg_orders
  FROM flagged GROUP BY 1""")
def _(spark, folder):
    return stable(returns.returner_comparison(flagged(spark, folder)))


@register("returner_share", f"SELECT {r('avg(CAST(ever_returned AS INTEGER)) * 100')} AS returner_pct FROM flagged")
def _(spark, folder):
    share = quality.share(flagged(spark, folder), F.col("ever_returned"), "s")
    return stable(share.select((F.col("s") * 100).alias("returner_pct")))


# ---------------------------------------------------------------- metadata and exports

ANALYSIS_TIME = "2024-01-01 00:00:00"


@register("run_metadata", f"""
  SELECT unnest(['Analysis Date', 'Data Period', 'Observation Date (for churn window)', 'Raw Records',
    'Cleaned Records', 'Purchase Records', 'Return / Cancellation Records', 'Special Stock-Code Rows Removed',
    'Total Customers', 'Gross Revenue (£)', 'Net Revenue after Returns (£)', 'Avg Customer Net Spend (£)',
    'Median Customer Net Spend (£)', 'Unique Countries', 'Customer Gini Coefficient',
    'RFM Segments Identified']) AS "Metric",
  unnest(['{ANALYSIS_TIME}',
    (SELECT strftime(min(invoice_date), '%Y-%m-%d') || ' to ' || strftime(max(invoice_date), '%Y-%m-%d') FROM raw),
    (SELECT strftime(max(last_purchase), '%Y-%m-%d') FROM base),
    CAST(raw_rows AS VARCHAR), CAST(clean_rows AS VARCHAR), CAST(bought AS VARCHAR), CAST(returned AS VARCHAR),
    CAST(keyed - clean_rows AS VARCHAR), (SELECT CAST(count(*) AS VARCHAR) FROM base),
    (SELECT format('{{:,.2f}}', sum(total_spend)) FROM base), (SELECT format('{{:,.2f}}', sum(net_spend)) FROM base),
    (SELECT format('{{:,.2f}}', avg(net_spend)) FROM base), (SELECT format('{{:,.2f}}', median(net_spend)) FROM base),
    (SELECT CAST(count(DISTINCT country) AS VARCHAR) FROM raw),
    (SELECT format('{{:.3f}}', 1 - 2 * sum((c + before) / 2 / n) FILTER (i > 1)) FROM (
       SELECT *, coalesce(lag(c) OVER (ORDER BY i), 0) AS before FROM (
         SELECT row_number() OVER w AS i, sum(total_spend) OVER w / sum(total_spend) OVER () AS c, count(*) OVER () AS n
         FROM base WINDOW w AS (ORDER BY total_spend, customer_id ROWS UNBOUNDED PRECEDING)))),
    (SELECT CAST(count(DISTINCT rfm_segment) AS VARCHAR) FROM base)]) AS "Value"
  FROM {COUNTS}""")
def _(spark, folder):
    at = F.lit(ANALYSIS_TIME).cast("timestamp_ntz")
    lines = tx(spark, folder)
    return run_metadata(lines, customers.stored_customer_base(stored_clean(spark, folder)), at)


@register("clean_totals", f"""
  UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS lines, CAST(count(DISTINCT customer_id) AS DOUBLE) AS customers,
    CAST(count(DISTINCT invoice_no) AS DOUBLE) AS invoices, {r('sum(line_amount)', 2)} AS value FROM clean)
  ON COLUMNS(*) INTO NAME metric VALUE value""")
def _(spark, folder):
    totals = clean(spark, folder).agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.count_distinct("customer_id").cast("double").alias("customers"),
        F.count_distinct("invoice_no").cast("double").alias("invoices"),
        F.sum("line_amount").alias("value"),
    )
    return metrics_long(stable(totals, 2))


@register("customer_base_dictionary", dictionary_sql(customers.BASE_COLUMNS, DESCRIPTIONS, "base"))
def _(spark, folder):
    return data_dictionary(base(spark, folder), DESCRIPTIONS)


@register("daily_display", f"""
  SELECT {day('invoice_date')} AS day, round(sum(line_amount), 2) AS revenue FROM pur GROUP BY 1""")
def _(spark, folder):
    daily = pur(spark, folder).groupBy(midnight(F.col("invoice_date")).alias("day")).agg(
        F.sum("line_amount").alias("revenue")
    )
    return round_columns(daily, 2)

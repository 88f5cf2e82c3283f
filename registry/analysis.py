"""Trends, cohorts, distributions, concentration and statistics."""

from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import split_by_type
from ebbtide.operators import concentration, distributions, gaps, quality, statistics, trends
from ebbtide.operators.features import FEATURE_COLUMNS
from ebbtide.runtime import materialized
from registry.churn import customer_features, stored_model_table, stored_sold
from registry.core import month, pur, r, register, stable, stored_clean, tx
from registry.preparation import base, flagged

HOME = "United Kingdom"


def stored_pur(spark, folder):
    return quality.purchases(stored_clean(spark, folder))


PRODUCTS = """
  SELECT stock_code, coalesce(name, stock_code) AS product_name, CAST(sum(quantity) AS BIGINT) AS quantity,
    sum(line_amount) AS amount
  FROM pur LEFT JOIN (
    SELECT stock_code, description AS name FROM (
      SELECT stock_code, description, row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) AS rn
      FROM pur WHERE description IS NOT NULL GROUP BY stock_code, description) WHERE rn = 1) USING (stock_code)
  GROUP BY ALL"""


@register("top_products_qty", f"""
  SELECT stock_code, product_name, quantity, {r('amount', 2)} AS revenue FROM ({PRODUCTS})
  ORDER BY quantity DESC, stock_code LIMIT 10""")
def _(spark, folder):
    return stable(trends.top_products(stored_pur(spark, folder), "quantity"), 2)


@register("top_products_revenue", f"""
  SELECT stock_code, product_name, quantity, {r('amount', 2)} AS revenue FROM ({PRODUCTS})
  ORDER BY amount DESC, stock_code LIMIT 10""")
def _(spark, folder):
    return stable(trends.top_products(stored_pur(spark, folder), "revenue"), 2)


MONTHLY = f"""(SELECT {month('invoice_date')} AS order_month, sum(line_amount) AS revenue,
  count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS active_customers FROM pur GROUP BY 1)"""
GROWTH = f"""(SELECT *, (revenue / lag(revenue) OVER w - 1) * 100 AS g_revenue,
  (orders / lag(orders) OVER w - 1) * 100 AS g_orders,
  (active_customers / lag(active_customers) OVER w - 1) * 100 AS g_customers
  FROM {MONTHLY} WINDOW w AS (ORDER BY order_month))"""


@register("monthly_trend", f"""
  SELECT order_month, {r('revenue', 2)} AS revenue, orders, active_customers FROM {MONTHLY}""")
def _(spark, folder):
    return stable(trends.monthly_trend(pur(spark, folder)), 2)


@register("mom_growth", f"""
  SELECT order_month, {r('revenue', 2)} AS revenue, orders, active_customers, {r('g_revenue')} AS revenue_mom_pct,
    {r('g_orders')} AS orders_mom_pct, {r('g_customers')} AS customers_mom_pct FROM {GROWTH}""")
def _(spark, folder):
    return stable(trends.mom_growth(trends.monthly_trend(pur(spark, folder))), revenue=2)


@register("partial_months", f"""
  SELECT order_month, orders, strftime(order_month, '%Y-%m') = (SELECT strftime(max(invoice_date), '%Y-%m') FROM pur)
    AND (SELECT max(CAST(invoice_date AS DATE)) < last_day(max(invoice_date)) FROM pur) AS is_partial FROM {MONTHLY}""")
def _(spark, folder):
    bought = stored_pur(spark, folder)
    return trends.flag_partial_month(trends.monthly_trend(bought), bought).select("order_month", "orders", "is_partial")


@register("growth_summary", f"""
  SELECT strftime(arg_max(order_month, revenue), '%Y-%m') AS peak_month,
    strftime(arg_min(order_month, revenue), '%Y-%m') AS trough_month, {r('avg(g_revenue)')} AS avg_revenue_mom_pct
  FROM {GROWTH}""")
def _(spark, folder):
    return stable(trends.growth_summary(trends.mom_growth(trends.monthly_trend(pur(spark, folder)))))


@register("monthly_net_revenue", f"""
  SELECT month, {r('net', 2)} AS net_revenue, orders FROM
    (SELECT strftime(invoice_date, '%Y-%m') AS month, sum(line_amount) AS net FROM clean GROUP BY 1)
    LEFT JOIN (SELECT strftime(invoice_date, '%Y-%m') AS month, count(DISTINCT invoice_no) AS orders FROM sold GROUP BY 1)
    USING (month)""")
def _(spark, folder):
    table = stored_clean(spark, folder)
    return stable(trends.monthly_net_revenue(table, quality.purchases(table, "not_return")), 2)


@register("weekly_counts", """
  SELECT week, coalesce(lines, 0) AS lines FROM
    (SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS week FROM
      (SELECT CAST(CAST(date_trunc('week', invoice_date) AS DATE) + 6 AS TIMESTAMP) AS w FROM sold))
    LEFT JOIN (SELECT CAST(CAST(date_trunc('week', invoice_date) AS DATE) + 6 AS TIMESTAMP) AS week, count(*) AS lines
      FROM sold GROUP BY 1) USING (week)""")
def _(spark, folder):
    return trends.weekly_counts(stored_sold(spark, folder))


WEEKDAY = f"""(SELECT dayname(invoice_date) AS day_of_week, CAST(isodow(invoice_date) AS INTEGER) AS position,
  count(DISTINCT invoice_no) AS orders, {r('sum(line_amount)', 2)} AS revenue,
  count(DISTINCT customer_id) AS customers FROM pur GROUP BY ALL)"""
HOUR = f"""(SELECT CAST(hour(invoice_date) AS INTEGER) AS hour_of_day, count(DISTINCT invoice_no) AS orders,
  {r('sum(line_amount)', 2)} AS revenue FROM pur GROUP BY ALL)"""


@register("purchases_by_weekday", f"SELECT * FROM {WEEKDAY}")
def _(spark, folder):
    return stable(trends.purchases_by_weekday(pur(spark, folder)), 2)


@register("purchases_by_hour", f"SELECT * FROM {HOUR}")
def _(spark, folder):
    return stable(trends.purchases_by_hour(pur(spark, folder)), 2)


@register("purchase_timing", f"""
  SELECT (SELECT day_of_week FROM {WEEKDAY} ORDER BY orders DESC, position LIMIT 1) AS busiest_day,
    (SELECT day_of_week FROM {WEEKDAY} ORDER BY orders, position LIMIT 1) AS quietest_day,
    (SELECT hour_of_day FROM {HOUR} ORDER BY orders DESC, hour_of_day LIMIT 1) AS peak_hour,
    CAST(sum(orders) FILTER (position >= 6) AS BIGINT) AS weekend_orders,
    {r('sum(orders) FILTER (position >= 6) * 100.0 / sum(orders)')} AS weekend_pct FROM {WEEKDAY}""")
def _(spark, folder):
    return stable(trends.timing_summary(stored_pur(spark, folder)))


@register("order_buckets", """
  SELECT order_bucket, CAST(b.position AS INTEGER) AS position, count(orders) AS customers FROM
    (SELECT unnest(['1 order', '2-5 orders', '6-10 orders', '11+ orders']) AS order_bucket,
            unnest([1, 2, 3, 4]) AS position, unnest([0, 1, 5, 10]) AS lo, unnest([1, 5, 10, 1000000000]) AS hi) b
    LEFT JOIN (SELECT count(DISTINCT invoice_no) AS orders FROM pur GROUP BY customer_id) ON orders > lo AND orders <= hi
  GROUP BY ALL""")
def _(spark, folder):
    return trends.order_buckets(pur(spark, folder))


COUNTRY = """(SELECT country, count(DISTINCT customer_id) AS customers, sum(line_amount) AS amount FROM pur GROUP BY 1)"""


@register("country_summary", f"""
  SELECT country, customers, {r('amount', 2)} AS revenue FROM {COUNTRY} ORDER BY amount DESC, country LIMIT 10""")
def _(spark, folder):
    return stable(trends.country_summary(pur(spark, folder), n=10), 2)


@register("country_summary_abroad", f"""
  SELECT country, customers, {r('amount', 2)} AS revenue FROM {COUNTRY} WHERE country <> '{HOME}'
  ORDER BY customers DESC, country LIMIT 10""")
def _(spark, folder):
    return stable(trends.country_summary(pur(spark, folder), "customers", HOME, 10), 2)


COHORTS = f"""(SELECT cohort_month, CAST((year(m) * 12 + month(m)) - (year(cohort_month) * 12 + month(cohort_month)) AS INTEGER)
    AS cohort_index, count(DISTINCT customer_id) AS customers
  FROM (SELECT DISTINCT customer_id, {month('invoice_date')} AS m,
          min({month('invoice_date')}) OVER (PARTITION BY customer_id) AS cohort_month FROM pur) GROUP BY ALL)"""
RETAINED = f"""(SELECT *, customers / max(CASE WHEN cohort_index = 0 THEN customers END) OVER (PARTITION BY cohort_month)
  AS retention FROM {COHORTS})"""


@register("cohort_counts", f"""
  SELECT cohort_month, cohort_index, customers, {r('retention', 6)} AS retention FROM {RETAINED}""")
def _(spark, folder):
    return stable(trends.cohort_counts(pur(spark, folder)), 6)


@register("cohort_retention", "SELECT cohort_month, " + ", ".join(
    f"{r(f'max(CASE WHEN cohort_index = {i} THEN retention * 100 END)')} AS month_{i}" for i in range(6)
) + f" FROM {RETAINED} GROUP BY 1 ORDER BY 1 LIMIT 8")
def _(spark, folder):
    return stable(trends.cohort_retention(pur(spark, folder)))


# ---------------------------------------------------------------- distributions

def _union(statements) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(statements) + ")"


TAILS = ["quantity", "price", "line_amount"]
TAIL_NAMES = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


@register("tail_summary", _union(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS {n}" for n, p in TAIL_NAMES.items())
    + f", {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg(CAST({c} < 0 AS INTEGER)) * 100')} AS negative_pct FROM raw"
    for c in TAILS))
def _(spark, folder):
    table = distributions.tail_summary(materialized(tx(spark, folder).select(*TAILS)), TAILS)
    return stable(table.withColumnRenamed("p99.9", "p99_9"))


SUMMARY_COLUMNS = ["customer_tenure_days", "total_spend", "purchase_lines", "unique_invoices", "avg_unit_price"]


@register("quantile_table", _union(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"{r(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS p{round(p * 100)}" for p in fv.SUMMARY_POINTS) + " FROM base"
    for c in SUMMARY_COLUMNS))
def _(spark, folder):
    return stable(distributions.quantile_table(base(spark, folder), SUMMARY_COLUMNS))


@register("quantile_table_approximate")
def _(spark, folder):
    return distributions.quantile_table(base(spark, folder), SUMMARY_COLUMNS, approximate=True)


NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c not in (
    "customer_id", "last_purchase_date", "first_purchase_date", "snapshot_date")]
DATE_FEATURES = ["customer_id", "last_purchase_date", "first_purchase_date", "snapshot_date"]


def _text(c: str) -> str:
    return c if c == "customer_id" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@register("describe_customers", _union([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
      {r(f'min({c})')} AS min, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
      {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75,
      {r(f'max({c})')} AS max, CAST(NULL AS DOUBLE) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS DOUBLE) AS freq
      FROM described""" for c in NUMERIC_FEATURES] + [
    f"""SELECT '{c}', CAST(sum(n) AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(count(*) AS DOUBLE),
      arg_min(v, (-n, v)), CAST(max(n) AS DOUBLE)
      FROM (SELECT {_text(c)} AS v, count(*) AS n FROM described GROUP BY 1)""" for c in DATE_FEATURES]))
def _(spark, folder):
    return stable(distributions.describe(materialized(customer_features(spark, folder))))


def _histogram(value: str, source: str, lo: str, hi: str, bins: int, inside: str = "true") -> str:
    return f"""
  WITH vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source}),
  ends AS (SELECT {lo} AS lo, {hi} AS hi FROM vals),
  cells AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS b, count(*) AS n
            FROM vals, ends WHERE v >= lo AND v <= hi AND {inside} GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bin, {r(f'lo + i * ((hi - lo) / {bins})')} AS lower,
    {r(f'lo + (i + 1) * ((hi - lo) / {bins})')} AS upper, coalesce(n, 0) AS count
  FROM range({bins}) g(i) CROSS JOIN ends LEFT JOIN cells ON b = i"""


@register("histogram_log1p", _histogram("ln(1 + line_amount)", "raw WHERE line_amount > 0", "min(v)", "max(v)", 60))
def _(spark, folder):
    return stable(distributions.histogram(tx(spark, folder), "line_amount", 60, "log1p"))


@register("histogram_to_p95", _histogram("line_amount", "pur", "0.0", "quantile_cont(v, 0.95)", 60))
def _(spark, folder):
    return stable(distributions.histogram(materialized(pur(spark, folder).select("line_amount")), "line_amount", 60, "p95"))


@register("histogram_gaps", _histogram(
    "gap_days", "(SELECT * FROM invgap WHERE gap_days <= (SELECT quantile_cont(gap_days, 0.95) FROM invgap))",
    "min(v)", "max(v)", 40))
def _(spark, folder):
    found = materialized(gaps.purchase_gaps(pur(spark, folder), "invoice").select("gap_days"))
    return stable(distributions.histogram(found, "gap_days", 40, "below_p95"))


@register("histogram_spend", _histogram("total_spend", "ctot", "min(v)", "max(v)", 50))
def _(spark, folder):
    return stable(distributions.histogram(base(spark, folder), "total_spend", 50))


@register("histogram_clipped", _histogram(
    "least(avg_gap_days, (SELECT quantile_cont(avg_gap_days, 0.99) FROM described))", "described", "min(v)", "max(v)", 40))
def _(spark, folder):
    table = materialized(customer_features(spark, folder))
    return stable(distributions.histogram(table, "avg_gap_days", 40, "p99"))


@register("ecdf_quantity", f"""
  SELECT CAST(quantity AS INTEGER) AS value, count(*) AS n,
    {r('sum(count(*)) OVER (ORDER BY quantity) / sum(count(*)) OVER ()', 6)} AS cumulative_share
  FROM raw GROUP BY quantity""")
def _(spark, folder):
    return stable(distributions.ecdf(tx(spark, folder), "quantity"), 6)


def _box(c: str) -> str:
    return f"""SELECT '{c}' AS "column", {r('any_value(q[1])')} AS p25, {r('any_value(q[2])')} AS p50,
      {r('any_value(q[3])')} AS p75,
      {r('min(v) FILTER (v >= q[1] - 1.5 * (q[3] - q[1]))')} AS whisker_low,
      {r('max(v) FILTER (v <= q[3] + 1.5 * (q[3] - q[1]))')} AS whisker_high,
      count(*) FILTER (v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS outliers
      FROM (SELECT ln(1 + {c}) AS v FROM pur),
        (SELECT quantile_cont(ln(1 + {c}), [0.25, 0.5, 0.75]) AS q FROM pur)"""


@register("box_stats", _union(map(_box, TAILS)))
def _(spark, folder):
    positive = materialized(pur(spark, folder).select(*TAILS))
    return stable(distributions.box_stats(positive, TAILS))


@register("gap_density", f"""
  WITH vals AS (SELECT least(CAST(gap_days AS DOUBLE), 200) AS v FROM daygap),
  f AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM vals),
  counted AS (SELECT v, count(*) AS w FROM vals GROUP BY v)
  SELECT CAST(i AS INTEGER) AS point, {r('any_value(lo + i * (hi - lo) / 199)')} AS grid_value,
    {r('sum(w * exp(-0.5 * pow((lo + i * (hi - lo) / 199 - v) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 8)} AS density
  FROM counted, f, range(200) g(i) GROUP BY i""")
def _(spark, folder):
    found = materialized(gaps.purchase_gaps(stored_sold(spark, folder), "day").select("gap_days"))
    return stable(distributions.density(found, "gap_days", 200, cap=200), density=8)


# ---------------------------------------------------------------- concentration

def _gini(value: str, source: str) -> str:
    return f"""SELECT max(i) AS entities, {r('1 - 2 * sum((c + before) / 2 / n) FILTER (i > 1)', 6)} AS gini FROM (
      SELECT *, coalesce(lag(c) OVER (ORDER BY i), 0) AS before FROM (
        SELECT row_number() OVER w AS i, sum(v) OVER w / sum(v) OVER () AS c, count(*) OVER () AS n
        FROM (SELECT greatest({value}, 0) AS v FROM {source})
        WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)))"""


PRODUCT_REVENUE = "(SELECT sum(line_amount) AS amount FROM pur GROUP BY stock_code)"


def product_revenue(spark, folder):
    return pur(spark, folder).groupBy("stock_code").agg(F.sum("line_amount").alias("amount"))


@register("gini_customers", _gini("total_spend", "ctot"))
def _(spark, folder):
    return stable(concentration.gini(trends.customer_orders(pur(spark, folder)), "spend"), 6)


@register("gini_orders", _gini("unique_invoices", "ctot"))
def _(spark, folder):
    return stable(concentration.gini(trends.customer_orders(pur(spark, folder)), "orders"), 6)


@register("gini_products", _gini("amount", PRODUCT_REVENUE))
def _(spark, folder):
    return stable(concentration.gini(product_revenue(spark, folder), "amount"), 6)


@register("lorenz_orders", f"""
  SELECT CAST(v AS DOUBLE) AS value, {r('sum(count(*)) OVER (ORDER BY v) / sum(count(*)) OVER ()', 6)} AS population_share,
    {r('sum(sum(v)) OVER (ORDER BY v) / sum(sum(v)) OVER ()', 6)} AS cumulative_share
  FROM (SELECT unique_invoices AS v FROM ctot) GROUP BY v""")
def _(spark, folder):
    return stable(concentration.lorenz(trends.customer_orders(pur(spark, folder)), "orders"), 6)


def _top(value: str, source: str, fraction: float, count: str) -> str:
    return f"""SELECT count(*) AS entities, CAST({count.format('count(*) * ' + str(fraction))} AS BIGINT) AS top_entities,
      {r(f'sum(v) FILTER (i <= {count.format("n * " + str(fraction))}) * 100 / sum(v)')} AS top_share_pct
      FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value} DESC) AS i, count(*) OVER () AS n FROM {source})"""


@register("pareto_customers", _top("total_spend", "ctot", 0.2, "floor({})"))
def _(spark, folder):
    return stable(concentration.top_share(trends.customer_orders(pur(spark, folder)), "spend", 0.2))


@register("pareto_products", _top("amount", PRODUCT_REVENUE, 0.2, "floor({})"))
def _(spark, folder):
    return stable(concentration.top_share(product_revenue(spark, folder), "amount", 0.2))


@register("top_decile_share", _top("total_spend", "ctot", 0.1, "greatest(ceil({}), 1)"))
def _(spark, folder):
    return stable(concentration.top_share(trends.customer_orders(pur(spark, folder)), "spend", 0.1, "ceil"))


# ---------------------------------------------------------------- statistics

def _correlations(columns, source: str) -> str:
    return _union(
        f"""SELECT '{a}' AS var1, '{b}' AS var2,
          covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS c FROM {source}"""
        for i, a in enumerate(columns) for b in columns[i + 1:])


CORRELATED = fv.CUSTOMER_CORRELATION_COLUMNS


@register("corr_pairs", f"""
  SELECT var1, var2, {r('c', 6)} AS correlation, {r('abs(c)', 6)} AS abs_correlation
  FROM ({_correlations(CORRELATED, 'base')}) WHERE c IS NOT NULL ORDER BY abs(c) DESC, var1, var2 LIMIT 10""")
def _(spark, folder):
    return stable(statistics.corr_pairs(base(spark, folder), CORRELATED), 6)


@register("corr_matrix", f"""
  SELECT var1, var2, {r('c', 6)} AS correlation FROM ({_correlations(CORRELATED, 'base')}) WHERE c IS NOT NULL""")
def _(spark, folder):
    return stable(statistics.correlations(base(spark, folder), CORRELATED), 6)


@register("corr_above_cutoff", f"""
  SELECT var1, var2, {r('c', 6)} AS correlation, {r('abs(c)', 6)} AS abs_correlation
  FROM ({_correlations(NUMERIC_FEATURES, 'described')}) WHERE abs(c) >= 0.8""")
def _(spark, folder):
    table = materialized(customer_features(spark, folder))
    numeric, _other = split_by_type(table)
    return stable(statistics.corr_pairs(table, numeric, top=None, cutoff=0.8), 6)


def _skew(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", CASE WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END AS s FROM described"


@register("skew_rank", f"""
  SELECT "column", {r('s')} AS skew FROM ({_union(map(_skew, NUMERIC_FEATURES))})
  ORDER BY s DESC, "column" LIMIT 8""")
def _(spark, folder):
    table = materialized(customer_features(spark, folder))
    return stable(statistics.skew_rank(table, split_by_type(table)[0]))


MODEL_FEATURES = [c for c in NUMERIC_FEATURES if c != "unique_descriptions"]


@register("corr_with_label", _union(
    f"""SELECT '{c}' AS feature,
      {r(f'covar_pop({c}, churn_label) / nullif(stddev_pop({c}) * stddev_pop(churn_label), 0)', 6)} AS correlation
      FROM model""" for c in MODEL_FEATURES))
def _(spark, folder):
    table = stored_model_table(spark, folder)
    return stable(statistics.corr_with_label(table, MODEL_FEATURES, "churn_label"), 6)


def _welch(c: str) -> str:
    return f"""SELECT '{c}' AS metric, ma, mb, (ma - mb) / sqrt(va / na + vb / nb) AS t,
      pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS v FROM (
        SELECT avg({c}) FILTER (ever_returned) AS ma, avg({c}) FILTER (NOT ever_returned) AS mb,
          var_samp({c}) FILTER (ever_returned) AS va, var_samp({c}) FILTER (NOT ever_returned) AS vb,
          count(*) FILTER (ever_returned) AS na, count(*) FILTER (NOT ever_returned) AS nb FROM flagged)"""


@register("welch_statistics", f"""
  SELECT metric, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('t')} AS t_statistic, {r('v')} AS degrees_of_freedom
  FROM ({_union(map(_welch, ['total_spend', 'total_orders']))})""")
def _(spark, folder):
    return stable(statistics.welch_statistics(flagged(spark, folder), "ever_returned", ["total_spend", "total_orders"]))


# the two-sided p-value as an integral of the density's tail: with x = sqrt(v) / tan(u) it is proportional to sin(u) ** (v - 1)
@register("welch_ttest", f"""
  WITH w AS ({_union(map(_welch, ['total_spend', 'total_orders']))}),
  e AS (SELECT *, atan(sqrt(v) / abs(t)) AS stop, greatest(0, atan(sqrt(v) / abs(t)) - 60 / sqrt(greatest(v, 1))) AS start FROM w),
  p AS (SELECT metric, (any_value(stop) - any_value(start)) / 60000 * 2 * exp(lgamma((any_value(v) + 1) / 2) - lgamma(any_value(v) / 2)) / sqrt(pi())
          * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                * CASE WHEN start + i * (stop - start) / 20000 > 0 THEN exp((v - 1) * ln(sin(start + i * (stop - start) / 20000))) ELSE 0 END) AS p
        FROM e, range(20001) g(i) GROUP BY metric)
  SELECT metric, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('t')} AS t_statistic, {r('v')} AS degrees_of_freedom,
    {r('p', 6)} AS p_value, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM w JOIN p USING (metric)""")
def _(spark, folder):
    found = statistics.welch_ttest(flagged(spark, folder), "ever_returned", ["total_spend", "total_orders"], places=12)
    return stable(found, p_value=6)

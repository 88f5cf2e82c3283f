"""Registration, the shared inputs, and the SQL building blocks of the checks.

Amounts are floating-point sums, whose last digits depend on the order of addition. Both sides
round them with ``NUDGE`` of the last place added, so that an exact tie, which noise may put on
either side, always goes up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators import quality
from ebbtide.runtime import materialized
from ebbtide.sources.fixtures import purchase_events, raw_transactions
from ebbtide.sources.transactions import typed_transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUDGE = 0.033


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_blocks(sql)
        return function
    return add


def stable(df: DataFrame, places: int = 4, **other: int) -> DataFrame:
    """Round the floating-point columns for comparison; ``other`` gives places by column."""
    rounded = {}
    for field in df.schema:
        if isinstance(field.dataType, T.DoubleType):
            p = other.get(field.name, places)
            rounded[field.name] = F.round(F.col(field.name) + NUDGE * 10.0 ** -p, p)
    return df.withColumns(rounded) if rounded else df


def r(expression: str, places: int = 4) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + {NUDGE * 10.0 ** -places!r}, {places})"


# ---------------------------------------------------------------- shared inputs

def tx(spark: SparkSession, folder: str) -> DataFrame:
    return typed_transactions(raw_transactions(spark, folder))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean_transactions(tx(spark, folder))


def pur(spark: SparkSession, folder: str) -> DataFrame:
    return quality.purchases(clean(spark, folder))


def ret(spark: SparkSession, folder: str) -> DataFrame:
    return quality.returns(clean(spark, folder))


def stored_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table written once, for queries that pass over it several times."""
    return materialized(clean(spark, folder))


def stored_unit(spark: SparkSession, folder: str) -> DataFrame:
    """The clean table as the churn steps read it: ``unit_price``, customer ids as text."""
    return materialized(clean(spark, folder).withColumnRenamed("price", "unit_price"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return purchase_events(spark, folder)


# ---------------------------------------------------------------- SQL building blocks

SPECIAL = """(trim(stock_code) IN ('POST','DOT','M','MANUAL','D','C2','BANK CHARGES','AMAZONFEE','CRUK','PADS','S','B')
  OR starts_with(upper(trim(stock_code)), 'TEST') OR starts_with(upper(trim(stock_code)), 'GIFT_')
  OR starts_with(upper(trim(stock_code)), 'BANK'))"""

DAYS = "CAST(floor((epoch_us({1}) - epoch_us({0})) / 86400000000.0) AS INTEGER)"


def days(start: str, end: str) -> str:
    return DAYS.format(start, end)


def day(ts: str) -> str:
    return f"CAST(CAST({ts} AS DATE) AS TIMESTAMP)"


def month(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS TIMESTAMP)"


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "planted": ((), """
      SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END
               || CAST(o_orderkey AS VARCHAR) AS invoice_no,
             CASE WHEN l_partkey % 97 = 0 THEN 'POST'
                  WHEN l_partkey % 89 = 0 THEN 'test' || CAST(l_partkey % 10 AS VARCHAR)
                  ELSE 'P' || CAST(l_partkey % 200 AS VARCHAR) END AS stock_code,
             CASE WHEN l_partkey % 61 <> 0 THEN p_name END AS description,
             CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity
                       ELSE l_quantity END AS INTEGER) AS quantity,
             o_orderdate + to_hours(CAST(o_orderkey % 10 + 8 AS INTEGER)) AS invoice_date,
             CASE WHEN l_partkey % 151 = 0 THEN 0.0
                  ELSE floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 END AS price,
             CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
             CASE n_nationkey % 7 WHEN 0 THEN 'United Kingdom' WHEN 1 THEN 'France' WHEN 2 THEN 'Germany' ELSE n_name END AS country,
             o_orderkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
    "raw": (("planted",), """
      SELECT * EXCLUDE (o_orderkey), quantity * price AS line_amount FROM planted
      UNION ALL
      SELECT * EXCLUDE (o_orderkey), quantity * price AS line_amount FROM planted WHERE o_orderkey % 50 = 1"""),
    "uniq": (("raw",), "SELECT DISTINCT * FROM raw"),
    "clean": (("uniq",), f"""
      SELECT * REPLACE (regexp_replace(customer_id, '\\.0$', '') AS customer_id) FROM uniq
      WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL AND NOT {SPECIAL}"""),
    "pur": (("clean",), "SELECT * FROM clean WHERE quantity > 0 AND price > 0"),
    "ret": (("clean",), "SELECT * FROM clean WHERE (quantity < 0 OR starts_with(invoice_no, 'C')) AND price > 0"),
    "sold": (("clean",), "SELECT * FROM clean WHERE NOT (quantity < 0 OR starts_with(invoice_no, 'C')) AND price > 0"),
    "back": (("clean",), "SELECT * FROM clean WHERE quantity < 0 OR starts_with(invoice_no, 'C')"),
    "ev": ((), """
      SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS invoice_no,
             ts AS invoice_date, value AS line_amount FROM events WHERE event_type = 'purchase'"""),
    # ---- customer base
    "ctot": (("pur",), f"""
      SELECT customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
             count(invoice_no) AS purchase_lines, count(DISTINCT invoice_no) AS unique_invoices,
             CAST(sum(quantity) AS BIGINT) AS total_quantity, sum(line_amount) AS total_spend,
             avg(price) AS avg_unit_price, count(DISTINCT country) AS countries,
             count(DISTINCT stock_code) AS distinct_products,
             count(DISTINCT CAST(invoice_date AS DATE)) AS days_active
      FROM pur GROUP BY customer_id"""),
    "prim": (("pur",), """
      SELECT customer_id, country AS primary_country FROM (
        SELECT customer_id, country, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, country) AS rn
        FROM pur GROUP BY customer_id, country) WHERE rn = 1"""),
    "rtot": (("ret",), """
      SELECT customer_id, count(invoice_no) AS return_count, sum(line_amount) AS return_value
      FROM ret GROUP BY customer_id"""),
    "wide": (("ctot", "prim", "rtot"), f"""
      SELECT ctot.*, primary_country, coalesce(return_count, 0) AS return_count,
             coalesce(return_value, 0.0) AS return_value,
             {days("first_purchase", "last_purchase")} AS customer_tenure_days,
             total_spend + coalesce(return_value, 0.0) AS net_spend,
             purchase_lines / unique_invoices AS avg_basket_size,
             total_spend / unique_invoices AS avg_order_value,
             coalesce(return_count, 0) / unique_invoices AS return_rate,
             strftime(first_purchase, '%Y-%m') AS first_purchase_month,
             CASE WHEN primary_country = 'United Kingdom' THEN 'UK'
                  WHEN primary_country IN ('Germany','France','Spain','Italy','Belgium','Netherlands','Portugal',
                    'Austria','Denmark','Finland','Greece','Ireland','Sweden','Poland','Czech Republic',
                    'Lithuania','Malta','Cyprus','EIRE') THEN 'EU' ELSE 'Other' END AS country_group,
             {days("last_purchase", "(SELECT max(last_purchase) FROM ctot)")} AS recency_days
      FROM ctot LEFT JOIN prim USING (customer_id) LEFT JOIN rtot USING (customer_id)"""),
    "edges": (("wide",), """
      SELECT quantile_cont(total_spend, [0.25, 0.5, 0.75]) AS s, quantile_cont(recency_days, [0.25, 0.5, 0.75]) AS d,
             count(*) AS n FROM wide"""),
    "places": (("wide",), """
      SELECT customer_id, row_number() OVER (ORDER BY unique_invoices, customer_id) AS place FROM wide"""),
    "scores": (("wide", "edges", "places"), """
      SELECT wide.*, unique_invoices AS frequency, total_spend AS monetary,
             4 - CAST(recency_days > d[1] AS INTEGER) - CAST(recency_days > d[2] AS INTEGER)
               - CAST(recency_days > d[3] AS INTEGER) AS r_score,
             1 + CAST(place > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(place > 1 + (n - 1) * 0.5 AS INTEGER)
               + CAST(place > 1 + (n - 1) * 0.75 AS INTEGER) AS f_score,
             1 + CAST(total_spend > s[1] AS INTEGER) + CAST(total_spend > s[2] AS INTEGER)
               + CAST(total_spend > s[3] AS INTEGER) AS m_score
      FROM wide JOIN places USING (customer_id), edges"""),
    "base": (("scores",), """
      SELECT *,
             CASE m_score WHEN 1 THEN 'Q1 (Lowest)' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' ELSE 'Q4 (Highest)' END AS spend_quartile,
             CASE WHEN unique_invoices <= 1 THEN 'One-time' WHEN unique_invoices <= 3 THEN 'Occasional (2-3)'
                  WHEN unique_invoices <= 10 THEN 'Regular (4-10)' ELSE 'Loyal (11+)' END AS frequency_segment,
             100 * r_score + 10 * f_score + m_score AS rfm_score,
             CASE WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Champions'
                  WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal Customers'
                  WHEN r_score >= 3 AND m_score >= 3 THEN 'Potential Loyalists'
                  WHEN r_score >= 3 THEN 'Recent Customers'
                  WHEN f_score >= 3 AND m_score >= 3 THEN 'High Value'
                  WHEN f_score >= 3 THEN 'Frequent Buyers'
                  WHEN recency_days > 180 THEN 'At Risk' ELSE 'Moderate' END AS rfm_segment
      FROM scores"""),
    # ---- returns
    "matched": (("ret", "pur"), """
      SELECT ret.*, first_purchase_dt, coalesce(first_purchase_dt <= invoice_date, false) AS matched_to_purchase
      FROM ret LEFT JOIN (SELECT customer_id, stock_code, min(invoice_date) AS first_purchase_dt
                          FROM pur GROUP BY ALL) USING (customer_id, stock_code)"""),
    "flagged": (("clean", "pur"), """
      SELECT customer_id, sum(line_amount) AS total_spend, count(DISTINCT invoice_no) AS total_orders,
             customer_id IN (SELECT customer_id FROM clean
               WHERE quantity < 0 OR price < 0 OR starts_with(invoice_no, 'C')) AS ever_returned
      FROM pur GROUP BY customer_id"""),
    # ---- gaps
    "invgap": (("pur",), f"""
      SELECT *, {days("previous_at", "purchased_at")} AS gap_days FROM (
        SELECT customer_id, invoice_no, invoice_date AS purchased_at,
               lag(invoice_date) OVER (PARTITION BY customer_id ORDER BY invoice_date, invoice_no) AS previous_at
        FROM (SELECT DISTINCT customer_id, invoice_no, invoice_date FROM pur)) WHERE previous_at IS NOT NULL"""),
    "tsgap": (("pur",), f"""
      SELECT *, {days("previous_at", "purchased_at")} AS gap_days FROM (
        SELECT customer_id, invoice_date AS purchased_at,
               lag(invoice_date) OVER (PARTITION BY customer_id ORDER BY invoice_date) AS previous_at
        FROM (SELECT DISTINCT customer_id, invoice_date FROM pur)) WHERE previous_at IS NOT NULL"""),
    "evgap": (("ev",), f"""
      SELECT *, {days("previous_at", "purchased_at")} AS gap_days FROM (
        SELECT customer_id, invoice_date AS purchased_at,
               lag(invoice_date) OVER (PARTITION BY customer_id ORDER BY invoice_date) AS previous_at
        FROM (SELECT DISTINCT customer_id, invoice_date FROM ev)) WHERE previous_at IS NOT NULL"""),
    "daygap": (("sold",), f"""
      SELECT customer_id, purchased_at, previous_at, CAST(date_diff('day', previous_at, purchased_at) AS INTEGER) AS gap_days FROM (
        SELECT customer_id, purchased_at, lag(purchased_at) OVER (PARTITION BY customer_id ORDER BY purchased_at) AS previous_at
        FROM (SELECT DISTINCT customer_id, {day("invoice_date")} AS purchased_at FROM sold)) WHERE previous_at IS NOT NULL"""),
    # ---- churn
    "thr": (("daygap",), """
      SELECT quantile_cont(gap_days, 0.9) AS gap_quantile,
             CAST(least(greatest(round_even(quantile_cont(gap_days, 0.9) / 30, 0) * 30, 60), 120) AS INTEGER) AS threshold_days
      FROM daygap"""),
    "win": (("sold", "thr"), f"""
      SELECT {day("min(invoice_date)")} AS obs_start,
             {day("max(invoice_date) - to_days((SELECT threshold_days FROM thr))")} AS snapshot,
             max(invoice_date) AS label_end, (SELECT threshold_days FROM thr) AS threshold_days
      FROM sold"""),
    "osold": (("sold", "win"), "SELECT sold.*, snapshot FROM sold, win WHERE invoice_date BETWEEN obs_start AND snapshot"),
    "oback": (("back", "win"), "SELECT back.* FROM back, win WHERE invoice_date BETWEEN obs_start AND snapshot"),
    "ogap": (("osold",), f"""
      SELECT customer_id, avg(gap) AS a, quantile_cont(gap, 0.5) AS m, CAST(max(gap) AS DOUBLE) AS x FROM (
        SELECT customer_id, date_diff('day', lag(purchased_at) OVER (PARTITION BY customer_id ORDER BY purchased_at), purchased_at) AS gap
        FROM (SELECT DISTINCT customer_id, {day("invoice_date")} AS purchased_at FROM osold)) GROUP BY customer_id"""),
    "oret": (("oback",), """
      SELECT customer_id, count(*) AS l, count(DISTINCT invoice_no) AS i, sum(abs(quantity)) AS q,
             sum(abs(line_amount)) AS v FROM oback GROUP BY customer_id"""),
    "ototal": (("osold",), """
      SELECT customer_id, any_value(snapshot) AS snapshot_date,
             min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
             count(DISTINCT invoice_no) AS frequency_orders, count(invoice_no) AS purchase_lines,
             sum(line_amount) AS monetary_total_spend, CAST(sum(quantity) AS BIGINT) AS total_quantity,
             count(DISTINCT stock_code) AS unique_products, count(DISTINCT country) AS unique_countries,
             avg(price) AS avg_unit_price, max(price) AS max_unit_price,
             count(DISTINCT CAST(invoice_date AS DATE)) AS distinct_active_days,
             count(DISTINCT strftime(invoice_date, '%Y-%m')) AS active_months,
             CAST(date_diff('day', max(invoice_date), any_value(snapshot)) AS INTEGER) AS recency_days,
             CAST(date_diff('day', min(invoice_date), any_value(snapshot)) AS INTEGER) AS tenure_since_first
      FROM osold GROUP BY customer_id"""),
    "feat": (("ototal", "ogap", "oret"), f"""
      SELECT ototal.*, {days("first_purchase", "last_purchase")} AS tenure_days,
             monetary_total_spend / frequency_orders AS avg_order_value,
             total_quantity / frequency_orders AS avg_qty_per_order,
             CAST(frequency_orders = 1 AS INTEGER) AS is_one_time_buyer,
             frequency_orders / greatest(tenure_since_first, 1) AS purchase_frequency_rate,
             recency_days / greatest(tenure_since_first, 1) AS recency_to_tenure_ratio,
             coalesce(a, tenure_since_first) AS avg_gap_days,
             coalesce(m, tenure_since_first) AS median_gap_days, coalesce(x, tenure_since_first) AS max_gap_days,
             coalesce(l, 0) AS return_lines, coalesce(i, 0) AS return_invoices,
             CAST(coalesce(q, 0) AS DOUBLE) AS returned_quantity, coalesce(v, 0.0) AS return_value,
             monetary_total_spend - coalesce(v, 0.0) AS net_spend,
             coalesce(i, 0) / frequency_orders AS return_invoice_ratio,
             coalesce(v, 0.0) / greatest(monetary_total_spend, 1e-9) AS return_value_ratio
      FROM ototal LEFT JOIN ogap USING (customer_id) LEFT JOIN oret USING (customer_id)"""),
    "model": (("feat", "sold", "win"), """
      SELECT feat.*, coalesce(f, 0) AS future_orders, CAST(coalesce(f, 0) = 0 AS INTEGER) AS churn_label
      FROM feat LEFT JOIN (
        SELECT customer_id, count(DISTINCT invoice_no) AS f FROM sold, win
        WHERE invoice_date > win.snapshot AND invoice_date <= label_end GROUP BY customer_id) USING (customer_id)"""),
    "scored": (("model",), """
      SELECT customer_id, churn_label AS y_true,
             floor(recency_days * 1000 / greatest(tenure_since_first, 1)) / 1000 AS y_prob FROM model"""),
    "steps": (("scored",), """
      SELECT y_prob, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg FROM scored GROUP BY y_prob"""),
    # ---- descriptive features
    "dret": (("back",), """
      SELECT customer_id, count(*) AS l, count(DISTINCT invoice_no) AS i,
             sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS q,
             sum(CASE WHEN line_amount < 0 THEN -line_amount ELSE 0 END) AS v FROM back GROUP BY customer_id"""),
    "dgap": (("tsgap",), """
      SELECT customer_id, avg(gap_days) AS a, quantile_cont(gap_days, 0.5) AS m, CAST(max(gap_days) AS DOUBLE) AS x
      FROM tsgap GROUP BY customer_id"""),
    "dtot": (("pur",), f"""
      SELECT customer_id, max(invoice_date) AS last_purchase_date, min(invoice_date) AS first_purchase_date,
             count(DISTINCT invoice_no) AS frequency_orders, count(invoice_no) AS purchase_lines,
             sum(line_amount) AS monetary_total_spend, CAST(sum(quantity) AS BIGINT) AS total_quantity,
             count(DISTINCT stock_code) AS unique_products, count(DISTINCT description) AS unique_descriptions,
             count(DISTINCT country) AS unique_countries, avg(price) AS avg_unit_price, max(price) AS max_unit_price,
             count(DISTINCT CAST(invoice_date AS DATE)) AS distinct_active_days,
             count(DISTINCT strftime(invoice_date, '%Y-%m')) AS active_months,
             (SELECT {day("max(invoice_date)")} + to_days(1) FROM pur) AS snapshot_date
      FROM pur GROUP BY customer_id"""),
    "described": (("dtot", "dret", "dgap"), f"""
      SELECT *, monetary_total_spend - return_value AS net_spend,
             return_invoices / frequency_orders AS return_invoice_ratio,
             coalesce(return_value / nullif(monetary_total_spend, 0), 0) AS return_value_ratio,
             monetary_total_spend / frequency_orders AS avg_order_value,
             total_quantity / frequency_orders AS avg_qty_per_order,
             CAST(frequency_orders = 1 AS INTEGER) AS is_one_time_buyer,
             frequency_orders / greatest(tenure_since_first, 1) AS purchase_frequency_rate,
             recency_days / greatest(tenure_since_first, 1) AS recency_to_tenure_ratio,
             coalesce(a, tenure_since_first) AS avg_gap_days,
             coalesce(m, tenure_since_first) AS median_gap_days, coalesce(x, tenure_since_first) AS max_gap_days
      FROM (SELECT dtot.*, a, m, x, coalesce(l, 0) AS return_lines, coalesce(i, 0) AS return_invoices,
                   CAST(coalesce(q, 0) AS DOUBLE) AS returned_quantity, coalesce(v, 0.0) AS return_value,
                   CAST(date_diff('day', last_purchase_date, snapshot_date) AS INTEGER) AS recency_days,
                   CAST(date_diff('day', first_purchase_date, snapshot_date) AS INTEGER) AS tenure_since_first,
                   {days("first_purchase_date", "last_purchase_date")} AS tenure_days
            FROM dtot LEFT JOIN dret USING (customer_id) LEFT JOIN dgap USING (customer_id))"""),
}


def with_blocks(sql: str) -> str:
    """Put the blocks a statement names, and those they need, in front of it."""
    import re

    wanted: list[str] = []

    def need(name: str) -> None:
        if name in wanted:
            return
        for dependency in BLOCKS[name][0]:
            need(dependency)
        wanted.append(name)

    for name in BLOCKS:
        if re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", sql):
            need(name)
    if not wanted:
        return sql
    blocks = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name][1]})" for name in wanted)
    rest = sql.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {blocks},\n{rest[5:]}"
    return f"WITH {blocks}\n{rest}"


def dictionary_sql(names: list[str], texts: dict[str, str], block: str) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string'
          WHEN 'TIMESTAMP' THEN 'datetime' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS dtype,
          '{texts[c]}' AS description, count({c}) AS non_null FROM {block}"""
        for i, c in enumerate(names, start=1)) + ")"

"""Label sets, code lists and column names that results depend on."""

# Source header (after normalising) -> column name.
RAW_ALIASES = {
    "invoice": "invoice_no",
    "invoiceno": "invoice_no",
    "stockcode": "stock_code",
    "invoicedate": "invoice_date",
    "unitprice": "price",
    "unit_price": "price",
    "customerid": "customer_id",
}

RAW_COLUMNS = [
    "invoice_no", "stock_code", "description", "quantity",
    "invoice_date", "price", "customer_id", "country",
]

# Stock codes that are charges or adjustments, not products: exact, case-sensitive.
SPECIAL_CODES = [
    "POST", "DOT", "M", "MANUAL", "D", "C2", "BANK CHARGES",
    "AMAZONFEE", "CRUK", "PADS", "S", "B",
]
# The same as prefixes, case-insensitive.
SPECIAL_PREFIXES = ["TEST", "GIFT_", "BANK"]

CANCEL_PREFIX = "C"

HOME_COUNTRY = "United Kingdom"
EU_COUNTRIES = [
    "Germany", "France", "Spain", "Italy", "Belgium", "Netherlands", "Portugal",
    "Austria", "Denmark", "Finland", "Greece", "Ireland", "Sweden", "Poland",
    "Czech Republic", "Lithuania", "Malta", "Cyprus", "EIRE",
]

SPEND_QUARTILES = ["Q1 (Lowest)", "Q2", "Q3", "Q4 (Highest)"]

# (upper edge, label); intervals are open on the left and closed on the right.
FREQUENCY_EDGES = [0, 1, 3, 10, None]
FREQUENCY_SEGMENTS = ["One-time", "Occasional (2-3)", "Regular (4-10)", "Loyal (11+)"]
ORDER_EDGES = [0, 1, 5, 10, None]
ORDER_BUCKETS = ["1 order", "2-5 orders", "6-10 orders", "11+ orders"]
RECENCY_EDGES = [-1, 30, 60, 90, 120, 180, 1_000_000]
RECENCY_BUCKETS = ["0-30", "31-60", "61-90", "91-120", "121-180", "180+"]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Share of a column's values below the named point.
TAIL_POINTS = [0.01, 0.5, 0.9, 0.95, 0.99, 0.999]
SUMMARY_POINTS = [0.1, 0.25, 0.5, 0.75, 0.9]

CUSTOMER_CORRELATION_COLUMNS = [
    "customer_tenure_days", "unique_invoices", "purchase_lines", "total_spend", "net_spend",
    "avg_order_value", "avg_basket_size", "avg_unit_price", "distinct_products", "countries",
    "return_count", "return_value", "return_rate",
]

# Columns of the modelling table that are never predictors.
NON_FEATURES = [
    "customer_id", "churn_label", "future_orders", "snapshot_date",
    "first_purchase", "last_purchase",
]
LABEL = "churn_label"
SEED = 42

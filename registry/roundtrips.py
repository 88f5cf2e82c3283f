"""Ingest and export: what is written and read again equals what the tables hold."""

from pyspark.sql import functions as F

from ebbtide.functions.scalars import map_labels, normalize_columns
from ebbtide.operators import evaluation, modelling, splitting
from ebbtide.operators.summaries import per_column
from ebbtide.runtime import materialized, new_path
from ebbtide.sources import sinks, transactions
from ebbtide.sources.fixtures import raw_transactions
from ebbtide.sources.ingest import ingest
from registry.analysis import MODEL_FEATURES
from registry.churn import stored_model_table
from registry.core import ORACLES, r, register, stable, stored_clean
from registry.modelling import scored
from registry.preparation import RAW

# what a delivery gets wrong, by the order's number
DEFECTS = {"Quantity": (43, "1O"), "InvoiceDate": (41, "soon"), "Price": (53, "free"), "Customer ID": (37, "n/a")}
NAMES = {"Quantity": "bad quantity", "InvoiceDate": "bad date", "Price": "bad price", "Customer ID": "bad customer id"}


def delivered(spark, folder):
    """The raw transactions as CSV files with bad fields in them, read through the reject channel."""
    order = F.regexp_replace("Invoice", "C", "").cast("long")
    raw = raw_transactions(spark, folder)
    bad = {c: F.when(order % n == 0, F.lit(text)).otherwise(F.col(c).cast("string")) for c, (n, text) in DEFECTS.items()}
    path = new_path(spark)
    sinks.write_table(raw.withColumns(bad), path, "csv")
    return ingest(spark, path)


ORDER = "CAST(replace(invoice_no, 'C', '') AS BIGINT)"
BAD = {NAMES[c]: f"{ORDER} % {n} = 0" for c, (n, _) in DEFECTS.items()}
ANY = " OR ".join(BAD.values())


@register("delivery_counts", "SELECT outcome, rows FROM (UNPIVOT (SELECT " + ", ".join(
    [f"count(*) FILTER (NOT ({ANY})) AS accepted", f"count(*) FILTER ({ANY}) AS rejected"]
    + [f"count(*) FILTER ({BAD[name]})" + f' AS "{name}"' if name in BAD else f'0::BIGINT AS "{name}"'
       for name in ("malformed line", "bad quantity", "bad date", "bad price", "bad customer id", "no invoice")])
    + " FROM raw) ON COLUMNS(*) INTO NAME outcome VALUE rows)")
def _(spark, folder):
    return delivered(spark, folder).counts()


@register("delivery_good_rows", f"SELECT {RAW}, {r('line_amount')} AS line_amount FROM raw WHERE NOT ({ANY})")
def _(spark, folder):
    return stable(delivered(spark, folder).good)


@register("delivery_rejected_rows", f"""
  SELECT invoice_no, stock_code, concat_ws('; ', {', '.join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in BAD.items())}) AS reasons,
    count(*) AS rows FROM raw WHERE {ANY} GROUP BY ALL""")
def _(spark, folder):
    found = delivered(spark, folder).rejected
    return found.groupBy("invoice_no", "stock_code", F.concat_ws("; ", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


@register("clean_or_raw", f"""
  SELECT invoice_no, stock_code, description, quantity, invoice_date, price AS unit_price, customer_id, country,
    {r('line_amount')} AS line_amount FROM raw WHERE customer_id IS NOT NULL AND invoice_date IS NOT NULL""")
def _(spark, folder):
    """No clean table lies there, so the raw one is read."""
    path = new_path(spark)
    sinks.write_table(normalize_columns(raw_transactions(spark, folder)), path, "parquet")
    return stable(transactions.read_clean_or_raw(spark, new_path(spark), path))


@register("written_clean", f"""
  SELECT invoice_no, stock_code, description, quantity, invoice_date, price, customer_id, country FROM clean""")
def _(spark, folder):
    path = new_path(spark)
    columns = [f.name for f in transactions.TRANSACTION_SCHEMA]
    sinks.write_table(stored_clean(spark, folder).select(*columns), path)
    return transactions.read_csv(spark, path, transactions.TRANSACTION_SCHEMA)


@register("written_metrics")
def _(spark, folder):
    path = new_path(spark)
    sinks.write_metrics(stable(evaluation.binary_metrics(scored(spark, folder)), 6), path)
    return transactions.read_metrics(spark, path)


@register("written_split")
def _(spark, folder):
    path = new_path(spark)
    sinks.write_split(*splitting.stratified_split(stored_model_table(spark, folder)), path)
    parts = [spark.read.parquet(f"{path}/{name}_split").withColumn("split", F.lit(name)) for name in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("churn_label", "split").agg(F.count(F.lit(1)).alias("rows"))


ORACLES["written_metrics"], ORACLES["written_split"] = ORACLES["binary_metrics"], ORACLES["stratified_split"]


# every row is scored, and a model read from disk scores as the one that was written
@register("saved_model_scores", """
  SELECT churn_label AS y_true, count(*) AS rows, 0::BIGINT AS differing, 0::BIGINT AS out_of_range, 0::BIGINT AS against_threshold FROM model GROUP BY 1""")
def _(spark, folder):
    table = stored_model_table(spark, folder)
    model, path = modelling.fit(table, "logistic_regression"), new_path(spark)
    sinks.save_model(model, path)
    one = evaluation.score(model, table).select("customer_id", "y_true", "y_prob", "y_pred")
    other = evaluation.score(transactions.load_model(path), table).select("customer_id", F.col("y_prob").alias("again"))
    return materialized(one).join(materialized(other), "customer_id").groupBy("y_true").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("y_prob") - F.col("again")) > 1e-12).alias("differing"),
        F.count_if(~F.col("y_prob").between(0, 1)).alias("out_of_range"),
        F.count_if((F.col("y_pred") == 1) != (F.col("y_prob") >= 0.5)).alias("against_threshold"))


# prepared features have mean 0 and population deviation 1, or are 0 where the feature is constant
@register("prepared_features", f"""
  SELECT feature, n, 0.0 AS mean, CASE WHEN sd > 0 THEN 1.0 ELSE 0.0 END AS deviation FROM ({' UNION ALL '.join(
    f"SELECT {i} AS feature, count(*) AS n, stddev_pop(coalesce({c}, m)) AS sd FROM model, (SELECT median({c}) AS m FROM model)"
    for i, c in enumerate(MODEL_FEATURES))})""")
def _(spark, folder):
    table = stored_model_table(spark, folder)
    numeric, categorical = modelling.feature_columns(table)
    ready = modelling.preprocessor(table, numeric, categorical).fit(table).transform(table)
    place = {c: i for i, c in enumerate(numeric)}
    x = modelling.vector_to_array(F.col("features"))
    values = ready.select(*[F.get(x, F.lit(place[c])).alias(f"x{i}") for i, c in enumerate(MODEL_FEATURES)])
    found = per_column(values, values.columns, {"n": F.count, "mean": F.avg, "deviation": F.stddev_pop})
    near = lambda c: F.round(F.col(c), 6) + 0.0
    return found.select(F.substring("column", 2, 3).cast("int").alias("feature"), "n", near("mean").alias("mean"), near("deviation").alias("deviation"))


@register("mapped_labels", """
  SELECT CASE country WHEN 'France' THEN 'FR' WHEN 'Germany' THEN 'DE' ELSE 'other' END AS code, count(*) AS lines FROM clean GROUP BY 1""")
def _(spark, folder):
    code = map_labels(F.col("country"), {"France": "FR", "Germany": "DE"}, "other")
    return stored_clean(spark, folder).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("lines"))

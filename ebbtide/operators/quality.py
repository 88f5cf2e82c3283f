"""Profiles, quality rules, cleaning and the purchase/return split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import fixed_values as fv
from ebbtide.functions.scalars import canonical_id, is_cancel, is_special_stock, with_line_amount


def is_purchase(rule: str = "positive", price: str = "price") -> Column:
    """``positive``: quantity and price above zero, whatever the invoice.
    ``not_return``: no return (see ``is_return``) and price above zero; quantity 0 is let in.

    Plain comparisons, so that a filter on them reaches the scan; a missing value meets none.
    """
    priced = F.col(price) > 0
    if rule == "positive":
        return (F.col("quantity") > 0) & priced
    if rule == "not_return":
        return ~is_return("any_price", price) & priced
    raise ValueError(f"unknown purchase rule: {rule}")


def is_return(rule: str = "priced", price: str = "price") -> Column:
    """Negative quantity or cancelled invoice. ``priced`` also asks for a price above zero,
    ``any_price`` does not look at it, ``or_negative_price`` counts negative prices too."""
    reversed_line = F.coalesce(F.col("quantity") < 0, F.lit(False)) | is_cancel(F.col("invoice_no"))
    if rule == "priced":
        return reversed_line & (F.col(price) > 0)
    if rule == "any_price":
        return reversed_line
    if rule == "or_negative_price":
        return reversed_line | F.coalesce(F.col(price) < 0, F.lit(False))
    raise ValueError(f"unknown return rule: {rule}")


def purchases(clean: DataFrame, rule: str = "positive", price: str = "price") -> DataFrame:
    return clean.filter(is_purchase(rule, price))


def returns(clean: DataFrame, rule: str = "priced", price: str = "price") -> DataFrame:
    return clean.filter(is_return(rule, price))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    # one test per column: unlike ``dropna`` these reach the scan
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def dedupe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact copies removed: of whole rows, or of the projection on ``columns``."""
    return df.distinct() if columns is None else df.select(*columns).distinct()


def drop_special(df: DataFrame) -> DataFrame:
    return df.filter(~is_special_stock(F.col("stock_code")))


def clean_transactions(tx: DataFrame) -> DataFrame:
    """Distinct product lines that have a customer and a date.

    The filters look only at columns of the row, so they run before the shuffle that finds the
    copies; removing a group of equal rows first or last leaves the same rows.
    """
    kept = drop_special(require(tx, ["customer_id", "invoice_date"]))
    # the amount follows from the other columns, so it need not travel through the shuffle
    unique = dedupe(kept, fv.RAW_COLUMNS)
    return with_line_amount(unique.withColumn("customer_id", canonical_id(F.col("customer_id"))))


def in_window(df: DataFrame, ts: str, lo: Column, hi: Column, closed: bool = True) -> DataFrame:
    """Rows from ``lo`` (``closed``) or after it, up to and including ``hi``."""
    after = F.col(ts) >= lo if closed else F.col(ts) > lo
    return df.filter(after & (F.col(ts) <= hi))


def _metric_rows(one_row: DataFrame, name: str, value: str) -> DataFrame:
    return one_row.unpivot([], one_row.columns, name, value)


def quality_flags(tx: DataFrame) -> DataFrame:
    """Rows that meet each of the seven quality rules."""
    counts = tx.agg(
        F.count_if(is_cancel(F.col("invoice_no"))).alias("cancel_invoice_rows"),
        F.count_if(F.col("quantity") < 0).alias("negative_qty_rows"),
        F.count_if(F.col("price") < 0).alias("negative_price_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_rows"),
        F.count_if(F.col("invoice_date").isNull()).alias("missing_date_rows"),
        F.count_if(is_special_stock(F.col("stock_code"))).alias("special_stock_code_rows"),
        F.count_if(F.col("price") == 0).alias("zero_price_rows"),
    )
    return _metric_rows(counts, "flag", "count")


def missing_pct(df: DataFrame, above_zero: bool = False) -> DataFrame:
    """Share of NULL per column in percent, largest first."""
    shares = df.agg(*[
        F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(c) for c in df.columns
    ])
    table = _metric_rows(shares, "column", "missing_pct")
    if above_zero:
        table = table.filter(F.col("missing_pct") > 0)
    return table.orderBy(F.desc("missing_pct"), "column")


def duplicate_count(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def column_profile(df: DataFrame) -> DataFrame:
    """Column, type and number of non-NULL values."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return _metric_rows(counts, "column", "non_null").withColumn("dtype", types[F.col("column")])


def cleaning_counts(tx: DataFrame) -> DataFrame:
    """One row with the row counts behind the waterfall and the validation report.

    One shuffle: rows are grouped into sets of copies, and every count follows from the sets.
    """
    keyed = F.col("customer_id").isNotNull() & F.col("invoice_date").isNotNull()
    special = is_special_stock(F.col("stock_code"))
    clean = keyed & ~special
    sets = tx.groupBy(*fv.RAW_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    rows_where = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return sets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"),
        F.count(F.lit(1)).alias("distinct_rows"),
        rows_where(F.col("customer_id").isNull()).alias("missing_customer"),
        rows_where(F.col("invoice_date").isNull()).alias("missing_date"),
        F.count_if(keyed).alias("keyed"),
        F.count_if(keyed & special).alias("special_removed"),
        F.count_if(clean).alias("clean"),
        F.count_if(clean & is_purchase()).alias("purchase"),
        F.count_if(clean & is_return()).alias("returned"),
    )


def cleaning_waterfall(tx: DataFrame) -> DataFrame:
    """Rows and percent of raw after each cleaning step.

    ``rows`` counts the rows really left. ``rows_by_subtraction`` takes the raw missing counts
    off the distinct rows instead, so copies lacking a key are subtracted twice.
    """
    counts = cleaning_counts(tx)
    by_subtraction = F.col("distinct_rows") - F.col("missing_customer") - F.col("missing_date")
    steps = [
        ("Raw", F.col("raw"), F.col("raw")),
        ("After dedupe", F.col("distinct_rows"), F.col("distinct_rows")),
        ("After drop missing customer_id / date", F.col("keyed"), by_subtraction),
        ("After remove special stock codes", F.col("clean"), F.col("clean")),
        ("After keep only positive qty & price", F.col("purchase"), F.col("purchase")),
    ]
    stacked = F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("stage"),
            rows.alias("rows"), subtracted.alias("rows_by_subtraction"),
            F.round(F.try_divide(rows * 100.0, F.col("raw")), 1).alias("pct_of_raw"),
        )
        for i, (name, rows, subtracted) in enumerate(steps, start=1)
    ])
    return counts.select(F.inline(stacked)).orderBy("step")


def validation_report(tx: DataFrame) -> DataFrame:
    checks = [
        ("Exact duplicates removed", F.col("raw") - F.col("distinct_rows"), "Removed"),
        ("Rows with missing customer_id removed", F.col("missing_customer"), "Removed"),
        ("Rows with missing invoice_date removed", F.col("missing_date"), "Removed"),
        ("Special / non-product stock codes removed", F.col("special_removed"), "Removed"),
        ("Non-positive quantity/price excluded", F.col("raw") - F.col("purchase"), "Removed"),
        ("Rows retained in cleaned set", F.col("clean"), "Retained"),
        ("Rows retained in purchase set", F.col("purchase"), "Retained"),
        ("Return / cancellation rows tracked separately", F.col("returned"), "Tracked separately"),
    ]
    stacked = F.array(*[
        F.struct(F.lit(name).alias("check"), count.alias("count"), F.lit(status).alias("status"))
        for name, count, status in checks
    ])
    return cleaning_counts(tx).select(F.inline(stacked))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, NULL left out; ``approximate`` keeps one small sketch each."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


def basic_profile(tx: DataFrame) -> DataFrame:
    """Rows, date range, distinct customers and distinct invoices."""
    return tx.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("invoice_no").alias("invoices"),
    )


def special_code_profile(tx: DataFrame, n: int = 20) -> DataFrame:
    """The special codes with most rows, what they add up to and a sample text."""
    return (
        tx.filter(is_special_stock(F.col("stock_code")))
        .groupBy(F.trim("stock_code").alias("stock_code"))
        .agg(
            F.count("invoice_no").alias("rows"),
            F.coalesce(F.sum("line_amount"), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.min("description"), F.lit("")).alias("sample_description"),
        )
        .orderBy(F.desc("rows"), "stock_code")
        .limit(n)
    )


def special_code_share(tx: DataFrame) -> DataFrame:
    special = is_special_stock(F.col("stock_code"))
    return tx.agg(
        F.count_if(special).alias("special_rows"),
        (F.avg(special.cast("int")) * 100).alias("special_pct"),
        F.coalesce(F.sum(F.when(special, F.col("line_amount"))), F.lit(0.0)).alias("special_value"),
    )


def share(df: DataFrame, condition: Column, name: str = "share") -> DataFrame:
    """Share of the rows that meet a condition; NULL counts as not met."""
    return df.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias(name))

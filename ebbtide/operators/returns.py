"""Returns against purchases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_by_pair(lines: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of many rows per key to at most one row per key.

    A hot key is one row on the right, so the adaptive skew join splits its left rows over tasks.
    Rows with a NULL in the key match nothing and do not take part in the shuffle.
    """
    whole = F.lit(True)
    for key in on:
        whole = whole & F.col(key).isNotNull()
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema if f.name not in on]
    unmatched = lines.filter(~whole).select("*", *added)
    return lines.filter(whole).join(pairs, list(on), "left").unionByName(unmatched)


def reconcile_returns(ret: DataFrame, pur: DataFrame) -> DataFrame:
    """Each return line with its pair's first purchase and whether that came no later."""
    first = pur.groupBy("customer_id", "stock_code").agg(
        F.min("invoice_date").alias("first_purchase_dt")
    )
    lines = ret.select("customer_id", "stock_code", "invoice_date", "quantity", "line_amount", "invoice_no")
    return joined_by_pair(lines, first, ["customer_id", "stock_code"]).withColumn(
        "matched_to_purchase",
        F.coalesce(F.col("first_purchase_dt") <= F.col("invoice_date"), F.lit(False)),
    )


def reconciliation_summary(ret: DataFrame, pur: DataFrame) -> DataFrame:
    """Return lines matched and unmatched, the value they reverse and what remains, in one row."""
    gross = pur.agg(F.coalesce(F.sum("line_amount"), F.lit(0.0)).alias("gross")).scalar()
    matched = F.col("matched_to_purchase")
    sums = reconcile_returns(ret, pur).agg(
        F.count(F.lit(1)).alias("return_lines"),
        F.count_if(matched).alias("matched_lines"),
        F.count_if(~matched).alias("unmatched_lines"),
        F.coalesce(F.sum("line_amount"), F.lit(0.0)).alias("returned_value"),
        F.coalesce(F.sum(F.when(matched, F.col("line_amount"))), F.lit(0.0)).alias("matched_value"),
    )
    return sums.withColumns({
        "matched_pct": F.coalesce(
            F.try_divide(F.col("matched_lines") * 100.0, F.col("return_lines")), F.lit(0.0)
        ),
        "gross_value": gross,
        "net_value": gross + F.col("returned_value"),
        "returned_pct_of_gross": F.try_divide(F.abs("returned_value") * 100, gross),
    })


def reconciliation_report(summary: DataFrame) -> DataFrame:
    """The summary as display rows ``(metric, value)``."""
    whole = lambda c: F.format_number(F.col(c), 0)
    money = lambda c: F.format_number(F.col(c), 2)
    rows = [
        ("Total return / cancellation lines", whole("return_lines")),
        ("Matched to a prior purchase", F.concat(
            whole("matched_lines"), F.lit(" ("), F.format_number("matched_pct", 1), F.lit("%)"))),
        ("Unmatched (no prior purchase found)", whole("unmatched_lines")),
        ("Total value reversed (£, negative)", money("returned_value")),
        ("Matched value reversed (£, negative)", money("matched_value")),
        ("Gross purchase value (£)", money("gross_value")),
        ("Net value after reconciliation (£)", money("net_value")),
        ("Return value as % of gross", F.concat(F.format_number("returned_pct_of_gross", 2), F.lit("%"))),
    ]
    return summary.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), text.alias("value")) for name, text in rows
    ])))


def flag_member(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """Whether the row's key occurs in another table. ``df`` has one row per key."""
    known = keys.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return df.join(known, on, "left").withColumn(name, F.coalesce("_known", F.lit(False))).drop("_known")


def customers_with_return_flag(return_lines: DataFrame, pur: DataFrame) -> DataFrame:
    """Spend and orders per customer, and whether the customer ever sent something back."""
    spend = pur.groupBy("customer_id").agg(
        F.sum("line_amount").alias("total_spend"),
        F.count_distinct("invoice_no").alias("total_orders"),
    )
    return flag_member(spend, return_lines, "customer_id", "ever_returned")


def returner_comparison(flagged: DataFrame) -> DataFrame:
    return (
        flagged.groupBy(
            F.when(F.col("ever_returned"), "Returned at least once").otherwise("No return")
            .alias("ever_returned")
        )
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("total_spend").alias("avg_spend"),
            F.avg("total_orders").alias("avg_orders"),
        )
        .orderBy("ever_returned")
    )

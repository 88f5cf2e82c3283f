"""Reading delivered transaction files: good rows typed, bad rows set apart with their reasons.

Every file is read as text first, so that nothing is lost to a failed cast. A row fails a rule when a field holds
something that is not what the field should hold; a missing value is no failure. Rows that fail
any rule go to the reject channel as they were delivered, with the names of all rules they failed. Good
and rejected rows are written in one pass, a folder each, and what is counted is what was written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.calendar import parse_ts
from ebbtide.functions.scalars import normalize_columns
from ebbtide.runtime import materialized
from ebbtide.sources.transactions import TRANSACTION_SCHEMA, typed_transactions

FIELDS = [f.name for f in TRANSACTION_SCHEMA]
LINE = "delivered_line"


def _given_but(field: str, readable: Column) -> Column:
    return F.col(field).isNotNull() & readable.isNull()


def rules(id_pattern: str = r"^[0-9]+(\.0)?$") -> dict[str, Column]:
    """What makes a delivered row unusable, by name of the rule."""
    return {
        "malformed line": F.col(LINE).isNotNull(),
        "bad quantity": _given_but("quantity", F.col("quantity").try_cast("double").try_cast("int")),
        "bad date": _given_but("invoice_date", parse_ts(F.col("invoice_date"))),
        "bad price": _given_but("price", F.col("price").try_cast("double")),
        "bad customer id": F.col("customer_id").isNotNull() & ~F.col("customer_id").rlike(id_pattern),
        "no invoice": F.col("invoice_no").isNull(),
    }


@dataclass(frozen=True)
class Delivery:
    """Typed good rows; rejected rows as text with ``reasons`` and, where a line did not parse, the line."""

    good: DataFrame
    rejected: DataFrame
    rule_names: Sequence[str]

    def counts(self) -> DataFrame:
        """Rows per rule, rules that nothing failed included, and rows accepted and rejected; a row can fail several rules."""
        failed = self.rejected.agg(
            F.count(F.lit(1)).alias("rejected"), *[F.count_if(F.array_contains("reasons", name)).alias(name) for name in self.rule_names])
        accepted = self.good.agg(F.count(F.lit(1)).alias("n")).scalar()
        names = ["rejected", *self.rule_names]
        return failed.select(F.inline(F.array(
            F.struct(F.lit("accepted").alias("outcome"), accepted.alias("rows")),
            *[F.struct(F.lit(name).alias("outcome"), F.col(f"`{name}`").alias("rows")) for name in names])))


def read_text_fields(spark: SparkSession, path: str) -> DataFrame:
    """The eight fields as text by their normalised headers, and the whole line where it has more or fewer fields.

    Files of one delivery share a header. One without a needed field raises ``ValueError``.
    """
    header = spark.read.option("header", True).csv(path)
    named = normalize_columns(header).columns
    missing = [f for f in FIELDS if f not in named]
    if missing:
        raise ValueError(f"the header of {path} lacks {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in [*header.columns, LINE])
    read = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", LINE).csv(path)
    return read.toDF(*named, LINE).select(*FIELDS, LINE)


def deliver(texts: DataFrame, checks: Mapping[str, Column] | None = None) -> Delivery:
    """Divide text rows into good and rejected ones by the rules."""
    checks = rules() if checks is None else checks
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    judged = texts.withColumn("reasons", failed).withColumn("accepted", F.size("reasons") == 0)
    stored = materialized(judged, ["accepted"])
    good = stored.filter("accepted").select(*FIELDS).withColumn("quantity", F.col("quantity").cast("double").cast("int"))
    return Delivery(typed_transactions(good), stored.filter("NOT accepted").drop("accepted"), list(checks))


def ingest(spark: SparkSession, path: str, checks: Mapping[str, Column] | None = None) -> Delivery:
    """Read CSV files with headers; see ``deliver``."""
    return deliver(read_text_fields(spark, path), checks)

"""Writing result tables, metrics, models and their descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_COLUMNS_AS_TEXT = "yyyy-MM-dd HH:mm:ss"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampNTZFormat", DATE_COLUMNS_AS_TEXT)
    writer.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def write_split(train: DataFrame, test: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep the exact split, so that a later evaluation sees the same held-out rows."""
    write_table(train, f"{path}/train_split", fmt)
    write_table(test, f"{path}/test_split", fmt)


def _dtype_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return dtype.simpleString()


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach descriptions to the columns, where a table format keeps them."""
    for name in df.columns:
        if name in comments:
            df = df.withMetadata(name, {"comment": comments[name]})
    return df


def data_dictionary(df: DataFrame, comments: Mapping[str, str] | None = None) -> DataFrame:
    """One row ``(position, column, dtype, description, non_null)`` per column of ``df``."""
    given = comments or {}
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(_dtype_name(f.dataType)).alias("dtype"),
            F.lit(given.get(f.name, f.metadata.get("comment", ""))).alias("description"),
            F.col(f.name).alias("non_null"),
        )
        for i, f in enumerate(df.schema, start=1)
    ]
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*entries)))


def metrics_long(df: DataFrame) -> DataFrame:
    """A one-row frame of metrics as rows ``(metric, value)``."""
    return df.unpivot([], df.columns, "metric", "value")


def export_predictions(scored: DataFrame, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """De-identified scores, four places."""
    return scored.select(F.col(label).alias("y_true"), F.round(score, 4).alias("y_prob"))

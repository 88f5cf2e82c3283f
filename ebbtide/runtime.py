"""Where intermediate results are written, and how lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names in ``spark.checkpoint.dir``, or else its warehouse folder.

    Both are the session's own settings and reachable from every executor. A cluster session
    without the first is refused, because the warehouse's default is a folder of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/ebbtide/{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession) -> None:
    """Give the session a folder for checkpoints if it has none.

    Fits that pass over the rows hundreds of times cut their lineage there; without one every task is sent
    the whole history of passes, which grows until it cannot be serialized.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_path(spark))


#: Spark's own setting; off by default, so that shuffle files stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch that Python is sent.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialized(df: DataFrame, folders: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Write to a parquet table in the shared folder and read it back.

    Cuts the lineage for results that several later passes read. Unlike a checkpoint the table
    is computed once and is columnar: each pass reads only its columns, and its filters reach
    the scan. With ``folders`` each value of those columns has files of its own, of the usual size.
    What was shuffled for the table is removed with the end of the write. With ``rows`` no more
    than those reach a Python function of ``df`` in one Arrow batch, which it holds whole.
    """
    spark = df.sparkSession
    path = new_path(spark)
    if folders:
        df = df.hint("rebalance", *folders)
    own = {CLEANUP: "true"} | ({BATCH: str(rows)} if rows else {})
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        df.write.partitionBy(*folders).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def resolved_row(df: DataFrame) -> dict[str, Column]:
    """A one-row frame computed now, as literals.

    For parameters that many expressions or a scan's filters use: literals reach the scan and
    keep the plan small, where a subquery would be copied into every expression.
    """
    row = df.first()
    literal = lambda v: F.lit(None if v is None else str(v)) if isinstance(v, datetime) else F.lit(v)
    return {f.name: literal(row[f.name]).cast(f.dataType) for f in df.schema}


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a scalar subquery: a struct to take its columns from.

    Every use is the same subquery, so Spark runs it once however many columns are taken.
    """
    return df.select(F.struct(*df.columns).alias("row")).scalar()

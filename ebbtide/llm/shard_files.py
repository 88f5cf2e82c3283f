"""Shards of binary files in key order, written by tasks and committed through a manifest.

A task writes each file under a temporary name that no other attempt uses. Spark stores the manifest
rows of the attempts that won; then each file of the manifest is renamed to the name that follows
from its shard and number. Files of lost or repeated attempts are in no manifest and go with the
temporary folder. Repeating the renaming after a failure does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.shared import filesystem
from ebbtide.runtime import materialized

#: Fine cells of the key's range whose sizes decide the shards: so many rows come to the driver at most.
CELLS = 4096
MANIFEST = "shard int, number int, temporary string, bytes long, sha256 string, records long, items long"


def shard_of(df: DataFrame, key: str, size: Column, target: int) -> tuple[Column, int]:
    """The shard of a row by its whole-number key, as a column, and the number of shards.

    Shards are consecutive ranges of the key of about ``target`` in size. They follow from the data
    alone, not from samples or partitions. A null key is in shard 0.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0), 1
    width = (high - low) // CELLS + 1
    cell = F.coalesce(F.expr(f"int((cast({key} as decimal(38, 0)) - ({low})) div {width})"), F.lit(0))
    sizes = dict(df.groupBy(cell.alias("cell")).agg(F.sum(size)).collect())
    shards, total = [], 0
    for c in range((high - low) // width + 1):
        shards.append(total // target)
        total += sizes.get(c) or 0
    first = {s: i for i, s in enumerate(dict.fromkeys(shards))}  # no numbers left out
    table = F.array(*[F.lit(first[s]) for s in shards])
    return F.element_at(table, cell + 1), len(first)


def in_shards(df: DataFrame, key: str, size: Column, target: int) -> tuple[DataFrame, int]:
    """Rows with a column ``shard``; see ``shard_of``."""
    shard, shards = shard_of(df, key, size, target)
    return df.withColumn("shard", shard), shards


class ShardFile:
    """One file being written under a temporary name."""

    def __init__(self, folder: str, shard: int, number: int) -> None:
        self.fs, base = filesystem(folder)
        self.fs.create_dir(f"{base}/temporary")
        self.shard, self.number, self.temporary = shard, number, f"temporary/{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(f"{base}/{self.temporary}")
        self.hash, self.bytes, self.records, self.items = hashlib.sha256(), 0, 0, 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.stream.close()
        return {"shard": self.shard, "number": self.number, "temporary": self.temporary, "bytes": self.bytes,
                "sha256": self.hash.hexdigest(), "records": self.records, "items": self.items}


def written(rows: DataFrame, shards: int, order: list[str | Column], write: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """Send each shard to a task in order; ``write`` turns its rows into files. Returns the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in write(batches):
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("shard", pa.int32()), ("number", pa.int32()), ("temporary", pa.string()), ("bytes", pa.int64()),
                ("sha256", pa.string()), ("records", pa.int64()), ("items", pa.int64())]))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *order)
    return materialized(dealt.mapInArrow(run, MANIFEST))


def committed(manifest: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Give the files of the manifest their names, write it as ``manifest`` and drop what is in none."""
    named = manifest.withColumn("name", F.format_string(f"shard-%05d-%03d{suffix}", "shard", "number"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = filesystem(folder)
                final = fs.get_file_info(f"{base}/{row['name']}")
                if final.size != row["bytes"]:
                    fs.move(f"{base}/{row['temporary']}", f"{base}/{row['name']}")
            yield batch

    done = named.mapInArrow(rename, named.schema).drop("temporary")
    done.write.parquet(f"{folder}/manifest")
    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base}/temporary").is_file is False and fs.get_file_info(f"{base}/temporary").type.name == "Directory":
        fs.delete_dir(f"{base}/temporary")
    return manifest.sparkSession.read.parquet(f"{folder}/manifest")


def contents(manifest: DataFrame, folder: str, suffix: str) -> DataFrame:
    """shard, number, content of the files that the manifest names."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "shard int, number int, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return files.select(name, "content").join(manifest.select("name", "shard", "number"), "name").select("shard", "number", "content")

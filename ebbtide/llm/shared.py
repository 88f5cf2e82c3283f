"""What the operators of this package have in common."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.runtime import shared_folder

#: ASCII white space, the only separators of words.
SPACES = " \t\n\v\f\r"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one; Spark and ``filesystem`` both take the path."""
    return f"{shared_folder(spark).rstrip('/')}/ebbtide/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a path or URI, and the path on it. For tasks and driver alike."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most so many rows and bytes, or one row, which bounds what a worker makes at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows)
            while some.num_rows > 1 and some.nbytes > size:
                some = some.slice(0, (some.num_rows + 1) // 2)
            yield some
            at += some.num_rows


_held: dict = {}


def kept[T](name: object, make: Callable[[], T]) -> T:
    """What a worker keeps between tasks: one thing, until another is asked for, so that what operators keep never adds up."""
    if name not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[name] = make()
    return _held[name]


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch. Ids pass through without pandas, which
    would turn nullable integers into floats."""
    return df.mapInArrow(lambda batches: map(function, slices(batches)), schema)


def unused(name: str, df: DataFrame) -> str:
    """The name, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys, columns of ``dropped`` by name, are together in no row there; null equals null."""
    names = {k: unused(f"_gone_{k}", docs) for k in keys}
    gone = dropped.select(*[F.col(k).alias(name) for k, name in names.items()]).distinct()
    return docs.join(gone, reduce(and_, [of.eqNullSafe(F.col(names[k])) for k, of in keys.items()]), "left_anti")

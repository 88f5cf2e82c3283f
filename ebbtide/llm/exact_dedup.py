"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own bytes say so, so equal texts are cut alike. A recipe is the ordered list
of the identifiers of its chunks; two texts are equal when their recipes are. Only recipes are
grouped and joined: the content moves once, per distinct chunk, to verify that no two different
chunks share an identifier. If two do, the identifiers are made anew with another key and verified
again, so the result is exact whatever the fingerprint does.

Null text equals the empty text, whose recipe is empty. Of equal texts the largest ``doc_id`` stays;
rows that share that ``doc_id`` are one document and stay together; null is the smallest id. Empty
input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.shared import over_batches, whole_text
from ebbtide.runtime import materialized

LEAST, MOST, BITS = 512, 16384, 11


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks: after eight bytes whose mixed value has ``bits`` leading zeros, at least
    ``least`` and at most ``most`` bytes from the cut before."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    four = b[3:] | b[2:-1] << 8 | b[1:-2] << 16 | b[:-3] << 24
    eight = four[4:].astype(np.uint64) | four[:-4].astype(np.uint64) << np.uint64(32)
    mixed = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    ends, last = [], 0
    for end in (np.flatnonzero(mixed == 0) + 8).tolist():
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least and end < n:
            ends.append(last := end)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def fingerprint(chunk: bytes, attempt: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16, key=attempt.to_bytes(4, "little")).digest()


def chunk_table(docs: DataFrame, attempt: int, identify: Callable[[bytes, int], bytes] = fingerprint) -> DataFrame:
    """id, content: every distinct chunk of every text."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {c for text in batch.column(0) for c in chunks(text.as_py().encode())}
        return pa.RecordBatch.from_arrays(
            [pa.array([identify(c, attempt) for c in found], pa.binary()), pa.array(list(found), pa.binary())], names=["id", "content"])
    return over_batches(docs.select(whole_text().alias("text")), cut, "id binary, content binary").distinct()


def recipes(docs: DataFrame, attempt: int, identify: Callable[[bytes, int], bytes] = fingerprint) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered chunk identifiers of every text, joined.

    Identifiers are of one length, so equal joined recipes are equal lists.
    """
    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [b"".join(identify(c, attempt) for c in chunks(text.as_py().encode())) for text in batch.column(2)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.binary())], names=["doc_id", "text_sha256", "recipe"])
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    narrow = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    return over_batches(narrow, describe, "doc_id long, text_sha256 string, recipe binary")


def exact_groups(docs: DataFrame, identify: Callable[[bytes, int], bytes] = fingerprint) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    attempt = 0
    while not chunk_table(docs, attempt, identify).groupBy("id").count().filter("count > 1").isEmpty():
        attempt += 1
    listed = materialized(recipes(docs, attempt, identify))
    # written, so that the join reads both sides through shuffles of their own and a hot recipe can be split
    groups = materialized(listed.groupBy("recipe").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1"))
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return listed.join(groups, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )

"""The corpus pipeline: quality rules, exact dedup, n-gram join, secret scan, packing.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs. A row is judged and dropped
by itself: it is known by its ``doc_id``, null like another, and its text, so that rows which share an
id do not go with one that is rejected. Rows repeated with id and text are one document: the exact dedup
keeps one of them, with the other columns it has. Near copies are those of Jaccard ``PERCENT`` over ``WORDS`` words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import exact_dedup, ngram_join, packing, quality_rules, secret_scan
from ebbtide.llm.queries import documents
from ebbtide.llm.shared import new_folder, unused, whole_text, without

WORDS, PERCENT = 5, 80


def row_id() -> Column:
    return F.col("doc_id").cast("long")


def text_hash() -> Column:
    return F.sha2(whole_text(), 256)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality(docs.withColumn("_sha256", text_hash()), carry=("_sha256",))
    # the rules' verdict follows from these, so equal rows have equal verdicts
    same = {"doc_id": row_id(), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "_sha256": text_hash()}
    return without(docs, judged.filter(~F.col("kept")), same)


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of largest id of each group of equal texts; of rows with the same id and text, one."""
    left = without(docs, exact_dedup.exact_groups(docs).filter(~F.col("kept")), {"doc_id": row_id(), "text_sha256": text_hash()})
    return left.dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row of smallest id of each component of near copies; of rows without an id, one where no other is."""
    node = F.xxhash64(row_id(), whole_text())  # the join takes rows of one id as one document, and none without
    found = ngram_join.jaccard_components(docs.select(node.alias("doc_id"), "text"), WORDS, PERCENT)
    parts = found.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    ids = docs.select(node.alias("_node"), row_id().alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_node").alias("first"))
    name = unused("_kept", docs)
    kept = ids.join(parts, "_node").groupBy("component_id").agg(first.alias("first")).select(F.col("first._node").alias(name))
    return docs.join(kept, node == F.col(name), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece with its sequence and place there."""
    placed = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("secret scan", secrets),
    ("best-fit packing", packed),
]

#: Similarity joins and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

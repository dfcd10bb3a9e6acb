"""A corpus from raw documents: quality rules, near copies, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Stages handle all tables alike: columns beside doc_id,
text and source are carried along under any names; long texts are taken whole; an empty table gives an empty one. What
becomes of nulls, empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallybrook.llm import jaccard_join, mix, packing, quality, suffix_dedup
from tallybrook.llm.common import delete, ensure_checkpoint_dir, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base figures or lie far from every reference language go. Null and empty texts have too few
    words, so they go; null ids and sources don't matter; repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id; of rows that share it, the first
    by text. Rows without id stay, and so do documents without words, which are near to nothing."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier are cut out: in a smaller doc_id, in a row without id, or further up
    in the document. A document that had text and keeps none goes; null and empty texts stay as they are."""
    return suffix_dedup.dedup(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice. A null source is a source of its own; null
    texts have no words and are drawn like others; rows that share an id are drawn alike."""
    return mix.mix(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's bucket, batch and position. Null and empty texts have length 1; rows without id are packed as well."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mixture),
    ("packing", length_buckets),
]

#: Near copies and repeated passages have no SQL that ends on whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns goes through Parquet in the shared folder, and is deleted when the
    next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs

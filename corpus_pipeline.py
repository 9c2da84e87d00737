"""The corpus pipeline: STAGES in order, each reading what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Null texts are empty texts, null languages and sources values of their own, and rows with a null doc_id stay where no
other row has their text.  Rows that repeat a doc_id come out of the second stage once.  Ties go to the smaller doc_id.
An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsqlspark.llm.common import written
from tsqlspark.llm.decontamination import decontaminated
from tsqlspark.llm.mixing import mixed_documents
from tsqlspark.llm.near_dedup import deduplicated
from tsqlspark.llm.quality import classified
from tsqlspark.llm.sharding import sharded_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classified(docs, labels).where("keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No documents with passages of two or more benchmark items; a passage of a single item is cut out of its document."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixed_documents(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` (8 of near-equal bytes) and ``slot``."""
    return sharded_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: The classifier and the key that documents are sharded by have no SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

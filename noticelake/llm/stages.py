"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents.

Each stage works on every row that it is given; all but the last return the columns of documents.
Null and empty texts pass every filter; texts of any length are read whole; repeated rows are one document for the
near-duplicate stage and rows of their own for the others; an empty table stays empty; other columns are carried whatever their names,
but the last stage replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, mixing, neardup, sharding, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not reject."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates."""
    return neardup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, each document as often as it is taken."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard (0 to 7) and slot."""
    return sharding.assign_shards(docs, n_shards=8)

"""A corpus pipeline: five stages over the documents, each one operator, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticelake.llm import stages
from noticelake.workspace import stored

STAGES = [
    ("toxicity", stages.without_toxic),
    ("near_dedup", stages.without_near_duplicates),
    ("decontamination", stages.without_benchmark),
    ("mixing", stages.mixed),
    ("sharding", stages.sharded),
]

#: The stages train models and follow graphs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return
documents' columns. The mix is random only by doc_id, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrafold.llm.decontamination import remove_leaks
from spectrafold.llm.mixing import mixed_documents
from spectrafold.llm.near_dedup import keep_one
from spectrafold.llm.quality_rules import filter_documents
from spectrafold.llm.sharding import shard_documents
from spectrafold.llm.shared import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL: decision lists, components and the virtual queue are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

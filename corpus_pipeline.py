"""Corpus pipeline: documents to a cleaned, mixed and sharded training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written and read again as the next stage's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textbench.llm import decontaminate, mixing, quality, reshard, simhash
from textbench.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reshard.reshard(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Models, fingerprints and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""From documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage reads all that the one before it kept.  A stage's result is written as Parquet and read again before the
next one starts: by run() in the session's shared folder, so a lost executor costs no more than the running stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quantmill.llm.decontaminate import decontaminate
from quantmill.llm.mixing import mixed_documents
from quantmill.llm.quality import kept_documents
from quantmill.llm.shared import shared_folder
from quantmill.llm.sharding import shard
from quantmill.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that too many documents of their source share."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the lowest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside benchmark passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their target weights."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix gets its shard and slot."""
    return shard(docs).drop("grown_shard")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: SimHash groups cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

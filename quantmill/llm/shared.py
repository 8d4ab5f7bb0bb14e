"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.  One is made only on a single machine where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def sent(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, which are written, for a join: sent to all tasks if they are ``most`` at most (counted), shuffled otherwise."""
    return F.broadcast(rows) if rows.count() <= most else rows


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared folder from now on, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_and_freed(df: DataFrame) -> DataFrame:
    """As written(), and Spark removes the files of its shuffles then, as nothing reads them any more."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, True)
    try:
        return written(df.select("*"))  # a plan takes the setting when it is made
    finally:
        conf.unset(key) if before is None else conf.set(key, before)

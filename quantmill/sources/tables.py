"""Tables of files that loads are merged into, a partition at a time.

A table is a folder with ``data``, which has files by load and partition, and ``log``, which has a row for each
partition that a load has written.  The latest row of a partition names its files; those before are history.  A load
reads and writes the partitions that it has rows for and no others.  Its log rows are one file, written last: Spark
renames it into place when it is whole, so a load that breaks off leaves the table as it was, and readers see a load
wholly or not at all.  One load runs at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantmill.functions.durable import written
from quantmill.sources.prices import upsert

LOG = "version long, part string, folder string, rows long"


@dataclass(frozen=True)
class Table:
    """root: a folder that all executors share.  schema: columns as DDL.  part: SQL expression of a row's partition."""

    root: str
    schema: str
    keys: tuple
    order: str
    part: str

    def log(self, spark: SparkSession) -> DataFrame:
        """Every partition that any load has written: version (1 is the first load), part, folder, rows."""
        spark.createDataFrame([], LOG).write.mode("ignore").json(f"{self.root}/log")
        return spark.read.schema(LOG).json(f"{self.root}/log")

    def _named(self, rows: DataFrame) -> DataFrame:
        """``rows`` with _part: "p" and their partition's value, "none" for null; so no name is empty."""
        return rows.withColumn("_part", F.coalesce(F.concat(F.lit("p"), F.expr(self.part).cast("string")), F.lit("none")))

    def current(self, spark: SparkSession, version: int | None = None) -> dict[str | None, tuple[str, int]]:
        """Folder and rows by partition, now or after a version; a row a partition comes to the driver."""
        log = self.log(spark)
        log = log if version is None else log.filter(F.col("version") <= version)
        latest = log.groupBy("part").agg(F.max_by(F.struct("folder", "rows"), "version").alias("x")).select("part", "x.folder", "x.rows").collect()
        return {_value(r["part"]): (r["folder"], r["rows"]) for r in latest}

    def version(self, spark: SparkSession) -> int:
        return self.log(spark).agg(F.max("version")).first()[0] or 0

    def read(self, spark: SparkSession, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows, of some partitions only if asked: files of others are not opened."""
        held = self.current(spark, version)
        return self._rows(spark, [f for p, (f, _) in held.items() if parts is None or p in parts])

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame) -> list[str | None]:
        """Upserts ``batch`` by the keys, the highest ``order`` wins, and gives the partitions that it has touched.

        A key must not move from one partition to another; let ``part`` depend on keys alone.  A partition that holds
        much of the load is written by several tasks.
        """
        spark = batch.sparkSession
        columns = spark.createDataFrame([], self.schema).columns
        rows = written(self._named(batch.select(*columns)))
        touched = [_value(r[0]) for r in rows.select("_part").distinct().orderBy("_part").collect()]
        if not touched:
            return []
        held, load = self.current(spark), f"data/{uuid.uuid4().hex}"
        old = self._named(self._rows(spark, [held[p][0] for p in touched if p in held]))
        merged = upsert(old, rows, list(self.keys), self.order)
        merged.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.root}/{load}")
        sizes = spark.read.option("basePath", f"{self.root}/{load}").schema(f"{self.schema}, _part string").parquet(f"{self.root}/{load}").groupBy("_part").agg(F.count("*")).collect()
        self._commit(spark, [(self.version(spark) + 1, p, f"{load}/_part={_escaped(p)}", n) for p, n in sizes])
        return touched

    def _commit(self, spark: SparkSession, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(f"{self.root}/log")


def _value(name: str) -> str | None:
    return None if name == "none" else name[1:]


def _escaped(value: str) -> str:
    """A partition's value as Spark writes it in folder names."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)

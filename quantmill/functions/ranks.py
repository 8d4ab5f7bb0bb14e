"""Order over a whole table without gathering it in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.durable import written

#: Bits that monotonically_increasing_id leaves for a row's place in its partition.
PLACE = 33


def with_count(rows: DataFrame, keys: tuple, out: str, of: Column | None = None) -> DataFrame:
    """``rows`` with the number of rows (or of known ``of``) by ``keys``; of the whole table, a row that is sent, without keys."""
    counted = F.count(F.lit(1) if of is None else of)
    if keys:
        return rows.withColumn(out, counted.over(Window.partitionBy(*keys)))
    return rows.crossJoin(F.broadcast(rows.agg(counted.alias(out))))


def numbered(rows: DataFrame, order: list[Column], out: str = "_rank") -> DataFrame:
    """``rows`` with ``out``, the place of each from 1 on, and ``_part``, the range that it is in.

    Ranges of the order are sorted each in a task of its own, and written, since they are read again.  What comes
    before a range is a number per range.
    """
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftrightunsigned("_id", PLACE)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << PLACE) - 1))).drop("_id")
    sizes, before = sorted(map(tuple, rows.groupBy("_part").agg(F.count("*")).collect())), []
    for part, n in sizes:
        before.append((part, before[-1][1] + before[-1][2] if before else 0, n))
    offsets = rows.sparkSession.createDataFrame([x[:2] for x in before], "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_before", "_at")


def least_from_here(rows: DataFrame, value: Column, rank: str, out: str) -> DataFrame:
    """``rows`` of numbered() with the least known ``value`` of each row and all after it.

    A range looks at its own rows; the least of the ranges after it is a number per range.
    """
    rows = rows.withColumn("_value", value)
    parts, later = sorted(map(tuple, rows.groupBy("_part").agg(F.min("_value")).collect()), reverse=True), []
    for part, least in parts:
        known = [x for x in later[-1][1:] if x is not None] if later else []
        later.append((part, min(known, default=None), least))
    after = rows.sparkSession.createDataFrame([x[:2] for x in later], "_part long, _later double")
    here = F.min("_value").over(Window.partitionBy("_part").orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(after), "_part").withColumn(out, F.least(here, F.col("_later"))).drop("_later", "_value")

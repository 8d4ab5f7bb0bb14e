"""Sharding by bytes: minimax contiguous partition of ordered atomic groups.

Equal texts share an md5, and the first four hex digits of it name one of 65,536 ordered groups.  A group is atomic,
so equal texts are never parted.  The sizes of the groups (a table of at most 65,536 sums, at any size of the input)
are what the driver sees: it searches the smallest capacity for which a greedy pass needs no more shards than there
are, and cuts there.  Rows are then numbered inside cells of a group, so a group of a third of all rows is spread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.llm.text import packed, unpacked, whole

SHARDS = 24
GROUPS = 1 << 16
OVERHEAD = 8
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts (index after each shard's last group) of a greedy pass from the left; None if it needs more shards."""
    cuts, done = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        done = int(ends[at - 1]) if at else 0
    return None


def minimax_cuts(sizes: np.ndarray, shards: int = SHARDS) -> list[int]:
    """For each shard the index after its last group, so that the largest shard is as small as can be.

    Among such cuts, the ones taken lie nearest to even shares of what is left.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return [len(ends)] * shards
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _greedy(ends, middle, shards) else (middle + 1, high)
    back = _greedy(np.cumsum(sizes[::-1], dtype=np.int64), low, shards)
    first = [len(ends) - x for x in back]  # first[k]: the earliest start from which k + 1 shards suffice
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        done = int(ends[at - 1]) if at else 0
        share = done + (int(ends[-1]) - done) / (left + 1)
        near = int(np.searchsorted(ends, share))
        near += near + 1 <= len(ends) and near > 0 and abs(ends[near - 1] - share) > abs(ends[min(near, len(ends) - 1)] - share)
        most = int(np.searchsorted(ends, done + low, side="right"))
        at = max(at, min(max(near, first[left - 1]), most))
        cuts.append(at)
    return [*cuts, len(ends)]


def group_sizes(docs: DataFrame) -> np.ndarray:
    """Bytes of each of the 65,536 groups."""
    sizes = np.zeros(GROUPS, np.int64)
    for r in docs.groupBy("_group").agg(F.sum("size").alias("size")).collect():
        sizes[r["_group"]] = r["size"]
    return sizes


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (null: this law moves rows when it grows).

    Null texts count as empty, repeated rows as rows, and an empty table gives an empty table.  Slots of a shard run
    from 0 without gaps, by group, then the first two digits of the md5 of the id, then id, then text; rows that tie
    in all of these are alike.  Columns of ``docs`` that have these six names are replaced, all others stay.
    """
    names = [c for c in docs.columns if c not in RESULT]
    docs, text = packed(docs), whole(F.col("row.text"))
    docs = docs.withColumn("size", (F.octet_length(text) + OVERHEAD).cast("long")).withColumn("text_crc32", F.crc32(text.cast("binary"))).withColumn("_md5", F.md5(text))
    docs = docs.withColumn("_group", F.conv(F.substring("_md5", 1, 4), 16, 10).cast("int")).withColumn("_cell", F.substring(F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 1, 2))
    docs = docs.withColumn("shard", _shard_of(F.col("_group"), minimax_cuts(group_sizes(docs), shards)))
    cells = docs.groupBy("shard", "_group", "_cell").agg(F.count("*").alias("_n"))
    before = lambda by, n: F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = cells.groupBy("shard", "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_group", before(Window.partitionBy("shard").orderBy("_group"), "_n").alias("_before"))
    cells = cells.select("_group", "_cell", before(Window.partitionBy("_group").orderBy("_cell"), "_n").alias("_offset"))
    cells = cells.join(groups, "_group").select("_group", "_cell", (F.col("_offset") + F.col("_before")).alias("_offset"))
    inside = Window.partitionBy("_group", "_cell").orderBy("row.doc_id", "_md5")
    docs = docs.withColumn("slot", F.row_number().over(inside)).join(cells, ["_group", "_cell"])
    docs = docs.withColumn("slot", (F.col("slot") - 1 + F.col("_offset")).cast("long")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return docs.select(*unpacked(names), *RESULT)


def _shard_of(group: Column, cuts: list[int]) -> Column:
    out = F.lit(0)
    for cut in cuts[:-1]:
        out = out + (group >= cut).cast("int")
    return out


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot by the law `bytes`; odd rows as in shard()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.llm.shared import written

MAX_ROUNDS = 60
#: Bytes of edges a partition, and of edges whose least neighbours are sent to all tasks and not shuffled.
PART_BYTES = 1 << 18
SENT_BYTES = 1 << 22


def _state(edges: DataFrame) -> tuple:
    """(rows, sum of hashes, bytes): equal only for equal edges."""
    size = F.octet_length(F.col("u").cast("string")) + F.octet_length(F.col("v").cast("string"))
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return r["n"], r["x"], r["size"]


def _fitted(edges: DataFrame, size: int) -> DataFrame:
    """``edges`` in no more partitions than their bytes ask for: the driver keeps a record of every task, whatever it has to do."""
    return edges.coalesce(1 + size // PART_BYTES)


def _to_least(edges: DataFrame, least: DataFrame, size: int) -> DataFrame:
    return edges.join(F.broadcast(_fitted(least, size)) if size <= SENT_BYTES else least, "u")


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = _to_least(both, least, size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return _fitted(moved.distinct(), size)


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _to_least(down, least, size).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return _fitted(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), size)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node it is linked to by any path.

    Edges stay distributed, in partitions after their bytes; each round is written to the shared folder.  Rounds grow as
    the logarithm of the nodes.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        size = state[-1]
        edges = written(_small_star(_large_star(_fitted(edges, size), size), size))
        before, state = state, _state(edges)
        if before == state:
            roots = _fitted(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), size)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")

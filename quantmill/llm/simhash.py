"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Two fingerprints at 4 bits or fewer differ in at most 4 of 7 blocks, so they agree in some 3 of them.  Each distinct
fingerprint is keyed by its 35 choices of 3 blocks (27 bits or more), which keeps buckets small as data grow.  Buckets
of two are compared as they are.  Larger ones are compared inside one row each, and give a spanning forest, not all
pairs.  Buckets over ``LARGE`` fingerprints are never gathered: their members meet at midpoints instead.  Two
fingerprints at 4 bits or fewer have a common neighbour within 2 bits of both, and any two that share such a
neighbour are at 4 bits or fewer, so linking each to the least one at every neighbour is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.llm.graph import connected_components
from quantmill.llm.shared import sent, written
from quantmill.llm.text import packed, unpacked

WORDS = 4
DISTANCE = 4
BLOCKS = 7
LARGE = 4096
CHUNK = 1 << 15
#: So many fingerprints of 16 bytes may be sent to all tasks.
FEW = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The unsigned fingerprint of a text; a text without words, or null, has 0."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(x) for x in batch], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col("text")))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One signed 64-bit mask for each choice of ``blocks - distance`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(members: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of members at ``distance`` or less; one row of distances at a time."""
    left, links = np.unique(members.astype(np.int64)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
            found, left = left[near], left[~near]
            links += [(int(at), int(x)) for x in found]
            front += found.tolist()
    return links


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [x for members in batch["members"] for x in forest(np.asarray(members))]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def close_links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """(a, b) at 4 bits or fewer that connect the distinct non-null ``fp`` of ``prints`` as all such pairs would."""
    masks = block_masks()
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    keys = prints.select("fp", keys.alias("k")).select("fp", "k.block", "k.bits")
    buckets = written(keys.groupBy("block", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = buckets.filter("n = 2").select("a", "b").distinct().filter(close)
    some = keys.join(buckets.filter((F.col("n") > 2) & (F.col("n") <= large)).select("block", "bits"), ["block", "bits"])
    some = some.groupBy("block", "bits").agg(F.sort_array(F.collect_list("fp")).alias("members")).select("members").distinct()
    many = keys.join(buckets.filter(F.col("n") > large).select("block", "bits"), ["block", "bits"]).select("fp").distinct()
    return pairs.union(some.mapInPandas(_bucket_links, "a long, b long").distinct()).union(_midpoint_links(many))


def _midpoint_links(prints: DataFrame) -> DataFrame:
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    flips = [x - (1 << 64) if x >> 63 else x for x in flips]
    near = prints.select("fp", F.explode(F.from_json(F.lit(str(flips)), "array<bigint>")).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return near.join(least, "mid").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()


def components(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    component_id is the smallest doc_id linked by any chain of fingerprints (null ids are ignored, and a group of
    none but null ids has null).  Equal texts, empty texts and null texts meet in their fingerprint.
    """
    prints = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    labels = written(connected_components(close_links(firsts.select("fp"), large)))
    labels = labels.select(F.col("node").alias("fp"), "root")
    lowest = labels.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("lowest"))
    found = firsts.join(labels.join(lowest, "root").select("fp", "lowest"), "fp", "left").filter("n > 1 or lowest is not null")
    # Written, so that both sides of the join are shuffled or one is sent, and Spark can split a fingerprint of very many rows.
    found = sent(written(found.select("fp", F.coalesce("lowest", "first").alias("lowest"))), FEW)
    return prints.join(found, "fp", "left").select("doc_id", "fp", F.coalesce("lowest", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """The document with the lowest doc_id of each component; columns as they were.

    Of rows that repeat a doc_id in one component, one stays.  Null ids stay only in a component of null ids, one row.
    """
    found = written(components(docs, large).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    repeated = found.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    ids = found.select(F.col("doc_id").alias("kept")).distinct()
    kept = packed(docs).join(ids, F.col("row.doc_id").eqNullSafe(F.col("kept")), "left_semi")
    if repeated:
        kept = with_fingerprint(kept.select("row", F.col("row.doc_id").alias("id"), F.col("row.text").alias("text"))).dropDuplicates(["id", "fp"])
    return kept.select(*unpacked(docs.columns))


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component; odd rows as in components()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Hard negatives of anchors: rows of other labels that score nearly as high as the anchor's best rows of its own label.

Anchors are a stated share of the rows.  They go out in chunks of a fixed size; all rows stay where they are and meet a
chunk in their own task, which keeps a few best rows for each anchor, and Spark merges what the tasks found.  A chunk
takes two scans: the best rows of the same label, then, with their scores as bounds, the best of other labels.

In a task, vectors are cut into segments.  With a segment's mean m and deviation d (the length of what is left without
the mean), the inner product of two segments of n entries is n * m * m' give or take d * d'.  Sums of that bound a
score from both sides.  Anchors and rows which, at a few segments, no score in reach is possible for go first, then the
same at more segments, and what is left is scored exactly, in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantmill.llm.shared import written
from quantmill.llm.vectors import matrix, usable

SCALE = 256
EVERY = 100
POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many hundredths of its positive's.
CLOSE = 80
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16)
#: Entries of the vectors of one chunk of anchors (at 8 bytes each).
CHUNK_ENTRIES = 1 << 22
TILE = 256


def prepared(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; labels of ids divisible by 7 move on by one."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _whole(vectors: pa.ListArray, size: int) -> np.ndarray:
    return np.floor(SCALE * matrix(vectors, size))


def facts(rows: DataFrame) -> tuple[int, float]:
    """(longest vector, largest sum of squares) of prepared rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(batch.column(0).value_lengths().to_pylist(), default=0)
            x = _whole(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([float((x * x).sum(axis=1).max(initial=0.0))])], ["size", "squares"])

    r = rows.select("vector").mapInArrow(measure, "size int, squares double").agg(F.max("size"), F.max("squares")).first()
    return r[0] or 0, r[1] or 0.0


def number_type(squares: float):
    """The fastest type that holds every score and every part of its sum exactly: none is above the largest square."""
    if squares >= 2.0**63:
        raise ValueError("scores do not fit into 64 bits")
    return np.float32 if squares < 2.0**24 else np.float64 if squares < 2.0**53 else np.int64


class Block:
    """Vectors with their segment summaries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, kind=np.float64, levels: tuple = LEVELS):
        self.x, self.ids, self.labels = x.astype(kind), ids, labels
        self.length, self.levels = np.sqrt((x * x).sum(axis=1)), []
        for s in levels:
            n = -(-max(x.shape[1], 1) // s)
            parts = np.pad(x, ((0, 0), (0, s * n - x.shape[1]))).reshape(len(x), s, n)
            mean = parts.mean(axis=2)
            self.levels.append((mean * math.sqrt(n), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))))

    def part(self, at) -> Block:
        out = object.__new__(Block)
        out.x, out.ids, out.labels, out.length = self.x[at], self.ids[at], self.labels[at], self.length[at]
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def pairs_in_reach(a: Block, b: Block, low: np.ndarray, high: np.ndarray, keep: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs of ``a`` and ``b`` with low[i] <= score <= high[i], scored exactly.

    If there are many, only those that can be among the ``keep`` highest of their i (with all ties) come.
    ``allowed``: a matrix of the pairs that count.
    """
    i, j = np.arange(len(a.ids)), np.arange(len(b.ids))
    mask = np.ones((len(i), len(j)), bool) if allowed is None else allowed
    slack = 1e-9 * (a.length.max(initial=0.0) * b.length.max(initial=0.0) + 1)
    for (m, d), (n, e) in zip(a.levels, b.levels, strict=True):
        middle, reach = m[i] @ n[j].T, d[i] @ e[j].T
        reach += slack
        mask = mask & (middle + reach >= low[i, None]) & (middle - reach <= high[i, None])
        some, cols = mask.any(axis=1), mask.any(axis=0)
        i, j, mask = i[some], j[cols], mask[np.ix_(some, cols)]
        if not len(i):
            return i, j, np.zeros(0)
    if mask.sum() < 0.05 * mask.size:
        p, q = np.nonzero(mask)
        scores = np.einsum("ij,ij->i", a.x[i[p]], b.x[j[q]])
        fine = (scores >= low[i[p]]) & (scores <= high[i[p]])
        return i[p[fine]], j[q[fine]], scores[fine].astype(float if a.x.dtype.kind == "f" else np.int64)
    scores = a.x[i] @ b.x[j].T
    mask = mask & (scores >= low[i, None]) & (scores <= high[i, None])
    if keep and scores.shape[1] > keep and mask.sum() > 4 * keep * len(i):
        held = np.where(mask, scores, -np.inf if a.x.dtype.kind == "f" else np.iinfo(np.int64).min)
        mask &= scores >= np.partition(held, -keep, axis=1)[:, -keep, None]
    p, q = np.nonzero(mask)
    return i[p], j[q], scores[p, q].astype(float if a.x.dtype.kind == "f" else np.int64)


class Best:
    """The ``most`` highest scores of each of n queries, ties by the smaller id."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)  # what a new score must reach

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]) if len(self.scores) else scores
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.most
        self.at, self.ids, self.scores = at[kept], ids[kept], scores[kept]
        self.least[at[place == self.most - 1]] = scores[place == self.most - 1]


def _batches(batches: Iterator[pa.RecordBatch], size: int, kind) -> Iterator[Block]:
    for batch in batches:
        yield Block(_whole(batch.column(2), size), batch.column(0).to_numpy(), batch.column(1).to_numpy(), kind)


def _found(best: Best, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(v) for v in columns.values()), pa.array(best.ids), pa.array(best.scores.astype(np.int64))], [*columns, "id", "score"])


def best_of_label(rows: DataFrame, anchors: Block, size: int, kind, most: int = POSITIVES) -> DataFrame:
    """(anchor, id, score): the best other rows of the same label of each anchor, by task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of_label = Best(len(anchors.ids), most), {k: np.nonzero(anchors.labels == k)[0] for k in np.unique(anchors.labels)}
        for rows in _batches(batches, size, kind):
            order = np.argsort(rows.labels, kind="stable")
            for at in np.split(order, np.nonzero(np.diff(rows.labels[order]))[0] + 1):
                mine = of_label.get(rows.labels[at[0]]) if len(at) else None
                for k in range(0, 0 if mine is None else len(mine), TILE):
                    own = mine[k : k + TILE]
                    a, b = anchors.part(own), rows.part(at)
                    i, j, scores = pairs_in_reach(a, b, best.least[own], np.full(len(own), np.inf), most + 1, a.ids[:, None] != b.ids)
                    best.add(own[i], b.ids[j], scores)
        yield _found(best, {"anchor": best.at.astype(np.int32)})

    return rows.mapInArrow(search, "anchor int, id long, score long")


def best_of_others(rows: DataFrame, anchors: Block, bounds: np.ndarray, size: int, kind, most: int = NEGATIVES, close: int = CLOSE) -> DataFrame:
    """(anchor, place, id, score): the best rows of other labels under each of an anchor's positive scores, by task.

    bounds: a row an anchor with its positives' scores, falling; nan where it has fewer.
    """
    with np.errstate(invalid="ignore"):
        floors = np.where(np.isnan(bounds), np.inf, np.ceil(bounds * close / 100))  # scores are whole: 100 * score >= close * bound
    tops = np.where(np.isnan(bounds), -np.inf, bounds)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, places = bounds.shape
        best = Best(n * places, most)
        for rows in _batches(batches, size, kind):
            for k in range(0, n, TILE):
                own = np.arange(k, min(k + TILE, n))
                a = anchors.part(own)
                low = np.maximum(floors[own], best.least.reshape(n, places)[own])
                i, j, scores = pairs_in_reach(a, rows, low.min(axis=1), tops[own].max(axis=1), 0, a.labels[:, None] != rows.labels)
                for p in range(places):
                    fine = (scores >= low[i, p]) & (scores <= tops[own[i], p])
                    best.add(own[i[fine]] * places + p, rows.ids[j[fine]], scores[fine])
        yield _found(best, {"anchor": (best.at // places).astype(np.int32), "place": (best.at % places).astype(np.int32)})

    return rows.mapInArrow(search, "anchor int, place int, id long, score long")


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, vector: str = "embedding", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, close: int = CLOSE, entries: int = CHUNK_ENTRIES) -> DataFrame:
    """A row for each hard negative of each positive of each anchor: see RESULT.

    Anchors are the rows whose vec_id is divisible by ``every``.  Rows with a null id, label or vector, or with a null
    or non-finite entry, take no part.  Shorter vectors end in zeros.  Rows that repeat an id are rows of their own,
    but none is a positive of an anchor with its id; anchors that repeat id, label and vector count once.  An anchor
    without others of its label, or without rows of other labels in reach, gives no row.  A positive with a score of
    zero or less has the negatives that the rule leaves: those of score zero, and none.
    """
    spark = rows.sparkSession
    rows = prepared(rows, vector)
    size, squares = facts(rows)
    kind, chunk = number_type(squares), max(1, entries // max(size, 1))
    queries = written(rows.filter(F.col("vec_id") % every == 0).dropDuplicates().withColumn("hash", F.xxhash64("vec_id", "label", "vector")))
    chunks, results = math.ceil(queries.count() / chunk), []
    for c in range(chunks):  # by hash, so a chunk has about as many as another
        part = queries.filter(F.pmod("hash", F.lit(chunks)) == c).orderBy("vec_id", "hash").select("vec_id", "label", "vector").toArrow()  # ``entries`` numbers, not all anchors
        if not part.num_rows:
            continue
        part = part.combine_chunks()
        ids = part.column("vec_id").to_numpy()
        anchors = Block(_whole(part.column("vector").combine_chunks(), size), ids, part.column("label").to_numpy(), kind)
        best = _first(best_of_label(rows, anchors, size, kind, positives), ["anchor"], positives).toPandas()
        bounds = np.full((len(ids), positives), np.nan)
        bounds[best["anchor"], best["rank"] - 1] = best["score"]
        if not len(best):
            continue
        best["place"], best["anchor_id"] = (best["rank"] - 1).astype("int32"), ids[best["anchor"]]
        own = spark.createDataFrame(pa.Table.from_pandas(best.rename(columns={"id": "positive_id", "score": "positive_score"})[["anchor", "place", "anchor_id", "positive_id", "positive_score"]], preserve_index=False))
        found = _first(best_of_others(rows, anchors, bounds, size, kind, negatives, close), ["anchor", "place"], negatives)
        results.append(found.join(own, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not results:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.union, results)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives in all embeddings of the anchors that op11's contract names; odd rows as in hard_negatives()."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

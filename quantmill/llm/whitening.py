"""Whitening of vectors: covariance by Spark, its leading eigenvectors by tridiagonalisation, projection by Spark.

Every task counts and adds up its rows' entries and Spark adds up the tasks' sums; then every task adds up the products
of its centred rows (a matrix of the vectors' dimension, whatever the number of rows) and Spark adds up those matrices,
entry by entry.  The driver gets
the covariance alone.  Householder reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues,
inverse iteration finds their vectors; those of close eigenvalues are made orthogonal to one another again.  The
components (8 at most) go out with the tasks that project the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.llm.vectors import matrix, usable_rows

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
EPS = np.finfo(float).eps
LONGEST = 2**63 - 1


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors) of Q'aQ for a symmetric matrix."""
    a, n, mirrors = np.array(a, float), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max()
        u = np.zeros(n - k - 1)
        if scale > 0:
            u[:] = x / max(scale, abs(x[0]))
            u[0] += math.copysign(np.linalg.norm(u), u[0])
            u /= np.linalg.norm(u)
            p = a[k + 1 :, k + 1 :] @ u
            w = p - (u @ p) * u
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, w) + np.outer(w, u))
            a[k + 1 :, k] -= 2 * u * (u @ x)
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each value: the negative pivots of T - value."""
    least = max(np.finfo(float).tiny, EPS * EPS * float(np.max(e * e, initial=0.0)))
    q, below = np.ones_like(at), np.zeros(len(at), int)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: every one bisected between Gershgorin's bounds until doubles end."""
    reach = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    margin = 4 * EPS * max(np.abs(d).max(), reach.max()) + np.finfo(float).tiny
    low, high = np.full(k, (d - reach).min() - margin), np.full(k, (d + reach).max() + margin)
    wanted = len(d) - np.arange(k)  # so many eigenvalues are at or below the k-th largest
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        enough = sturm_counts(d, e, middle) >= wanted
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)


def _solve(d: np.ndarray, e: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """x of T x = b by elimination with row exchanges; pivots under ``least`` are raised to it."""
    n = len(d)
    diag, up, up2, x, sub = d.copy(), np.append(e, 0.0), np.zeros(n), b.copy(), e
    for i in range(n - 1):
        if abs(sub[i]) > abs(diag[i]):
            factor = diag[i] / sub[i]
            diag[i], up[i], up2[i], diag[i + 1], up[i + 1] = sub[i], diag[i + 1], up[i + 1], up[i] - factor * diag[i + 1], -factor * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            diag[i] = diag[i] if abs(diag[i]) > least else math.copysign(least, diag[i])
            factor = sub[i] / diag[i]
            diag[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    diag[-1] = diag[-1] if abs(diag[-1]) > least else math.copysign(least, diag[-1])
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / diag[i]
        if abs(x[i]) > 1e100:
            x *= 1e-100
    return x


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of a tridiagonal matrix by inverse iteration from a fixed start.

    Within a cluster a vector is made orthogonal to those before it at every step, twice over, since once leaves what
    cancellation has spoilt.
    """
    norm = max(float(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0)), np.finfo(float).tiny)
    random, found = np.random.default_rng(0), []
    for k, value in enumerate(values):
        near = [found[j] for j in range(k) if values[j] - value <= CLUSTER * norm]
        x = random.standard_normal(len(d))
        for _ in range(6):
            for v in near + near:
                x = x - (v @ x) * v
            x = _solve(d - value, e, x / np.linalg.norm(x), EPS * norm)
            x = x / np.abs(x).max()
        for v in near + near:
            x = x - (v @ x) * v
        found.append(x / np.linalg.norm(x))
    return np.array(found).reshape(len(values), len(d))


def leading_components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows), the largest first; eigenvalues that are zero but for rounding are left out.

    The entry of a vector that is largest in size is positive (the first of such entries at a tie).
    """
    size = len(covariance)
    norm = float(np.abs(covariance).max(initial=0.0))
    if not norm:
        return np.zeros(0), np.zeros((0, size))
    d, e, mirrors = tridiagonal(covariance / norm)
    values = leading_eigenvalues(d, e, min(most, size))
    values = values[values > 16 * size * EPS * max(values[0], 0.0)]
    vectors = eigenvectors(d, e, values)
    for k in range(len(mirrors) - 1, -1, -1):
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ mirrors[k], mirrors[k])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.abs(vectors).argmax(axis=1)
    return values * norm, vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


class Whitening(NamedTuple):
    """What a fit gives: rows, their sums, mean, trace of the covariance, eigenvalues, components and whether n * x - sum is small.

    ``safe``: the sum of squared deviations from the sums fits into 64 bits for every row.
    """

    n: int
    size: int
    sums: np.ndarray
    mean: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    safe: bool

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def whole_numbers(vectors: pa.ListArray, size: int) -> np.ndarray:
    """The entries of vectors as whole numbers, which doubles hold (up to 2^53 on either side)."""
    most = 2.0**53 - 2 * SHIFT
    return np.floor(np.clip(matrix(vectors, size) * SCALE, -most, most)) + SHIFT


class Sums:
    """Number, exact sums and ends of the entries of whole-number rows."""

    def __init__(self, size: int):
        self.n, self.sums, self.low, self.high = 0, np.zeros(size, object), np.full(size, LONGEST), np.full(size, -LONGEST)

    def add(self, x: np.ndarray) -> None:
        x = x.astype(np.int64)
        self.n += len(x)
        self.sums = self.sums + ((x >> 24).sum(axis=0).astype(object) << 24) + (x & ((1 << 24) - 1)).sum(axis=0).astype(object)  # halves, whose sums stay within 64 bits
        self.low, self.high = np.minimum(self.low, x.min(axis=0)), np.maximum(self.high, x.max(axis=0))


def entry_sums(rows: DataFrame) -> DataFrame:
    """(size, i, n, sum, low, high) of the entries of ``vector``, by the vectors' length and place."""
    schema = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("sum", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Sums] = {}
        for batch in usable_rows(batches):
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for size in map(int, np.unique(lengths)):
                part = batch.column(0) if (lengths == size).all() else batch.column(0).filter(pa.array(lengths == size))
                found.setdefault(size, Sums(size)).add(whole_numbers(part, size))
        for size, s in found.items():
            if size:
                columns = [np.full(size, size), np.arange(size), np.full(size, s.n), [Decimal(int(v)) for v in s.sums], s.low, s.high]
            else:
                columns = [[0], [0], [s.n], [Decimal(0)], [0], [0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sums = rows.select("vector").mapInArrow(add, "size int, i int, n long, sum decimal(38,0), low long, high long")
    return sums.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))


def _added(products: DataFrame) -> np.ndarray:
    """Sum of the tasks' matrices; Spark adds them up entry by entry, and so the driver gets one matrix."""
    sums = products.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(sums["i"].max()) + 1 if len(sums) else 0
    out = np.zeros((size, size))
    out[sums["i"], sums["j"]] = sums["v"]
    return (out + out.T) / 2


def _products(rows: DataFrame, of, size: int) -> DataFrame:
    """(i, row): the rows of each task's sum of products of ``of(x)``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in usable_rows(batches):
            y = of(whole_numbers(batch.column(0), size))
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return rows.filter(F.size("vector") == size).select("vector").mapInArrow(add, "i int, row array<double>")


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vector`` of ``rows``; None if there is none."""
    entries = F.sort_array(F.collect_list(F.struct("i", "sum", "low", "high"))).alias("entries")  # an entry a dimension
    found = entry_sums(rows).groupBy("size").agg(F.max("n").alias("n"), entries).orderBy(F.desc("n"), F.desc("size")).first()
    if found is None or not found["size"]:
        return None
    size, n, entries = found["size"], found["n"], found["entries"]
    sums = [int(r["sum"]) for r in entries]
    furthest = sum(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) ** 2 for r, s in zip(entries, sums, strict=True))
    mean = np.array([s // n + (s % n) / n for s in sums])
    covariance = _added(_products(rows, lambda x: x - mean, size)) / n
    values, vectors = leading_components(covariance, most)
    return Whitening(n, size, np.array(sums, object), mean, float(np.trace(covariance)), values, vectors, furthest <= LONGEST)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    if not len(w.values):
        return 0.0
    found = _added(_products(rows, w.project, w.size)) / w.n  # whitened rows are centred
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """A row for each row of ``rows`` (vec_id, vector) and component, as the contract of op13 has it."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        sums = w.sums.astype(np.int64) if w.safe else w.sums
        for batch in usable_rows(batches, 1):
            x = whole_numbers(batch.column(1), w.size)
            rows = len(x)
            own = x.astype(np.int64).astype(sums.dtype)
            deviation = ((own * w.n - sums) ** 2).sum(axis=1)
            deviation = [d if d <= LONGEST else None for d in deviation] if not w.safe else deviation
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, w.n), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(w.project(x).ravel()), pa.array(np.tile(w.values / w.trace, rows)), pa.array(np.full(rows * k, error)),
            ], [c.split()[0] for c in RESULT.split(", ")])

    return rows.filter(F.size("vector") == w.size).select("vec_id", "vector").mapInArrow(project, RESULT)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_vectors(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Every usable vector of ``rows`` (vec_id and ``vector``) on each of the leading components.

    Null vectors and those with a null or non-finite entry are dropped.  Vectors must have one length: of others, only
    those of the most frequent length take part (the longest of such at a tie).  Components whose eigenvalue is zero
    are left out, so equal vectors, a single one and an empty table give no rows.  Repeated rows and null ids are rows
    like any other.  A deviation beyond 64 bits is null.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    w = fit(rows, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    return whiten(rows, w, identity_error(rows, w))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on the eight leading components of their covariance; odd rows as in whitened_vectors()."""
    return whitened_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

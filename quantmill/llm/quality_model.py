"""A quality classifier: document statistics, random Fourier features, ridge regression, isotonic calibration.

A text gives some forty statistics (character classes and how they follow one another, word lengths, repeats of words,
lines and windows, the worst stretch of the text), all from the text as a whole.  They are standardised by the learnt
rows' mean and deviation.  Cosines of random projections of them approximate a Gaussian kernel (Rahimi and Recht, 2007).
Every partition adds up its rows' normal equations, a matrix of FEATURES + 1 each way, Spark adds up the partitions',
and the driver solves them: ridge scores.  Other learnt rows, which the regression has not seen, calibrate them: their
scores are counted on a fixed grid, and pooled neighbours (isotonic regression) turn the grid into shares of label 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.llm.shared import written
from quantmill.llm.text import whole

FEATURES = 256
#: Width of the Gaussian kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 2.0
RIDGE = 0.1
#: Rows that are learnt from, about; of more labelled rows a share is taken by hashes of their ids.
MOST_ROWS = 200_000
PARTS = 16
FOLDS, CALIBRATED = 5, 4
THRESHOLD = 0.3
#: Ridge scores are counted in cells of this width for calibration.
CELL = 1 / 256

# Character classes: 0 control, 1 blank, 2 line end, 3 digit, 4 upper case, 5 lower case, 6 not ASCII, 7 sentence marks, 8 quotes and brackets, 9 other symbols.
CLASSES = 10
CLASS = np.full(256, 9, np.uint8)
CLASS[:32], CLASS[127] = 0, 0
CLASS[[32, 9]], CLASS[[10, 13]] = 1, 2
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = 3, 4, 5, 6
CLASS[[ord(c) for c in ".,;:?-"]] = 7
CLASS[[ord(c) for c in "\"'()[]{}"]] = 8
STRETCH = 256
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text: str) -> list[float]:
    """The statistics of one text; an empty one has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = WORD.findall(text)
    n, w = len(raw), len(words)
    kinds = CLASS[raw]
    share = np.bincount(kinds, minlength=CLASSES) / max(n, 1)
    letters = share[4] + share[5] + share[6]
    follows = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES) / max(n - 1, 1) if n > 1 else np.zeros((CLASSES, CLASSES))
    bytes_seen = np.bincount(raw, minlength=256) / max(n, 1)
    seen = bytes_seen[bytes_seen > 0]
    # The text in stretches of STRETCH bytes (the last one may be longer): the worst of them by symbols and upper case.
    cuts = np.arange(0, max(n - STRETCH, 0) + 1, STRETCH)
    lengths = np.diff(np.append(cuts, n))
    worst = lambda hit: float((np.add.reduceat(hit, cuts) / lengths).max()) if n else 0.0
    sizes = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1)
    counts = Counter(words)
    distinct, most = len(counts), max(counts.values(), default=0)
    again = sum(map(eq, words, words[1:]))
    windows = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    line_sizes = [len(x) for x in lines]
    once = set(lines)
    capital = follows[1, 4] + follows[2, 4]
    return [
        math.log1p(n), math.log1p(w), float(sizes.mean()), float(sizes.std()), math.log1p(float(sizes.max())),
        distinct / max(w, 1), distinct / max(w, 1) ** 0.8, most / max(w, 1), again / max(w - 1, 1),
        1 - windows / (w - 2) if w > 2 else 0.0, 1 - len(once) / max(len(lines), 1), 1 - sum(map(len, once)) / max(sum(line_sizes), 1),
        math.log1p(len(lines)), math.log1p(sum(line_sizes) / max(len(lines), 1)),
        *share, letters, share[4] / max(letters, 1e-9), float(-(seen * np.log(seen)).sum()),
        worst(kinds == 9), worst(kinds == 4), worst(kinds == 3), worst(kinds == 2),
        follows[9, 9], follows[1, 9], follows[9, 1], follows[5, 9], follows[4, 4], follows[5, 4], follows[7, 1], follows[7, 9], capital, follows[5, 7], follows[3, 3],
        float((bytes_seen[[ord(c) for c in "aeiouAEIOU"]]).sum() / max(share[4] + share[5], 1e-9)) if share[4] + share[5] else 0.0,
    ]


N_STATISTICS = len(statistics(""))


def statistics_of(texts: list) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(-1, N_STATISTICS)


class Model(NamedTuple):
    """What is learnt: standardisation, projection, weights and calibration; and the seed's projection itself."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    offset: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.projection + self.offset) * math.sqrt(2 / len(self.offset)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(x), self.knots, self.shares), 0.0, 1.0)


def untrained(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 12) -> Model:
    random = np.random.default_rng(seed)
    projection = random.standard_normal((len(mean), features)) / (width * math.sqrt(len(mean)))
    return Model(mean, scale, projection, random.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))


def isotonic(cells: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, shares): pooled neighbours over cells in rising order; a pool stands at its rows' mean cell.

    Between pools shares are interpolated, so that different scores stay different.
    """
    pools: list[list[float]] = []
    for c, n, k in zip(cells, rows, ones, strict=True):
        pools.append([c * n, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _summed(rows: DataFrame, of, schema_size: int) -> np.ndarray:
    """Sum over all rows of what ``of`` makes of a batch: (x, y) -> a square matrix.  Spark adds up the partitions'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((schema_size, schema_size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, N_STATISTICS)
            total += of(x, batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(schema_size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("x", "y").mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((schema_size, schema_size))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def _with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` (text, y, part) as (x, y, part)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "part"])

    return rows.select("text", "y", "part").mapInArrow(make, "x array<double>, y int, part int")


def learnt_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS, folds: int = FOLDS) -> DataFrame:
    """(text, y, part) of the labelled documents that may be learnt from: part is their fold, 1 and above.

    A document's label is the one its id has; ids whose labels differ, null labels and labels other than 0 and 1 teach
    nothing.  Of more than ``most`` ids a share is taken by their hashes, so that about ``most`` are left; these few are
    sent to the texts, which stay where they are.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).filter("y = z and doc_id is not null")
    known = known.withColumn("part", fold(F.col("doc_id"), folds).cast("int")).filter("part <> 0").select("doc_id", "y", "part")
    known = written(known)
    share = most / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y", "part")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, most: int = MOST_ROWS) -> Model:
    """The model of the labelled rows outside the held-out fold; without any, every score is one half."""
    rows = written(_with_statistics(learnt_rows(docs, labels, label, most))).coalesce(PARTS)  # each part sends a matrix
    k = N_STATISTICS
    fitted, checked = rows.filter(F.col("part") != CALIBRATED), rows.filter(F.col("part") == CALIBRATED)

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((k + 1, k + 1))
        out[0, :k], out[1, :k], out[2, 0], out[2, 1] = x.sum(axis=0), (x * x).sum(axis=0), len(x), y.sum()
        return out

    m = _summed(fitted, moments, k + 1)
    n = m[2, 0]
    if not n:
        return untrained(np.zeros(k), np.ones(k), features, width)._replace(knots=np.zeros(1), shares=np.full(1, 0.5))
    mean = m[0, :k] / n
    deviation = np.sqrt(np.maximum(m[1, :k] / n - mean * mean, 0))
    model = untrained(mean, np.where(deviation > 1e-9 * (1 + np.abs(mean)), deviation, np.inf), features, width)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.hstack([model.features(x), y[:, None]])
        return z.T @ z

    a = _summed(fitted, normal, features + 2)
    penalty = np.diag(np.append(np.full(features, ridge), 1e-9))
    model = model._replace(weights=np.linalg.solve(a[:-1, :-1] + penalty, a[:-1, -1]))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.round(model.ridge(batch.column(0).flatten().to_numpy().reshape(-1, k)) / CELL), -1024, 1024).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["cell", "y"])

    calibrating = checked if not checked.isEmpty() else fitted
    grid = calibrating.select("x", "y").mapInArrow(cells, "cell int, y int").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("k")).orderBy("cell").toPandas()  # 2,049 cells at most
    knots, shares = isotonic(grid["cell"].to_numpy() * CELL, grid["n"].to_numpy(float), grid["k"].to_numpy(float))
    return model._replace(knots=knots, shares=shares)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null texts are empty; a text of any length is read as a whole.  Repeated rows get a row each.  A null id is not
    held out.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(statistics_of(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [c.split()[0] for c in SCORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(score, SCORED)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document with its quality score, learnt from the labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, train(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))

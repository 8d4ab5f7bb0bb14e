"""Hard negatives, the quality classifier and whitening against plain versions, and on odd input."""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.llm import hard_negatives, quality_model, queries, whitening
from tests.compare import database, difference

DATA = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")
ODD_SCHEMA = "vec_id long, label int, embedding array<float>, rank int, n long, x string"


def odd_vectors(spark, n: int = 130):
    """Ties, equal vectors, negative and zero scores, a hot label, ids with a null, repeated rows, clashing names."""
    random = np.random.default_rng(5)
    rows = [(i, int(random.choice([0, 0, 0, 1, 2])), [float(v) / 8 for v in random.integers(-3, 4, 6)], 1, 2, "x") for i in range(n)]
    rows += [(200, 0, [0.5] * 6, 0, 0, ""), (201, 0, [0.5] * 6, 0, 0, ""), (202, 1, [0.5] * 6, 0, 0, ""), (203, 1, [0.5] * 6, 0, 0, ""), (300, 5, [-0.5] * 6, 0, 0, ""), (301, 5, [0.5] * 6, 0, 0, ""), (400, 9, [0.0] * 6, 0, 0, "")]
    rows += [(None, 0, [0.5] * 6, 0, 0, ""), (500, None, [0.5] * 6, 0, 0, ""), (501, 0, None, 0, 0, ""), (600, 0, [0.5, None] * 3, 0, 0, ""), (601, 0, [NAN] * 6, 0, 0, ""), (602, 0, [INF] * 6, 0, 0, ""), (603, 0, [-INF] * 6, 0, 0, "")]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)


# 11 ------------------------------------------------------------------------------------------------------------------
def plain_negatives(rows: list[tuple]) -> set[tuple]:
    able = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v]) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, ka, va in able:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v, strict=True)), i, k) for i, k, v in able)
        for s, i, k in [x for x in scored if x[2] == ka and x[1] != a][:5]:
            near = [(t, j) for t, j, kj in scored if kj != ka and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("entries", [hard_negatives.CHUNK_ENTRIES, 12])
def test_hard_negatives(spark, entries):
    rows = odd_vectors(spark)
    found = hard_negatives.hard_negatives(rows, entries=entries)
    assert [f"{n} {t}" for n, t in found.dtypes] == hard_negatives.RESULT.replace("long", "bigint").split(", ")
    plain = plain_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in rows.collect()])
    assert len({a for a, *_ in plain}) >= 3
    assert sorted(map(tuple, found.collect())) == sorted(plain)


def test_hard_negatives_query(spark):
    assert not difference(queries.op11_hard_negatives(spark, DATA), database(DATA).sql(queries.OP11_SQL))


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_segment_summaries_lose_no_pair(kind):
    """Clustered vectors, so that the bounds rule pairs out; those that stay are the ones in reach."""
    random = np.random.default_rng(2)
    centres = random.integers(-90, 90, (6, 50))
    make = lambda n: (centres[random.integers(0, 6, n)] + random.integers(-9, 9, (n, 50))).astype(float)
    a, b = (hard_negatives.Block(make(n), np.arange(n), np.zeros(n, int), kind) for n in (40, 300))
    scores = a.x.astype(np.int64) @ b.x.astype(np.int64).T
    low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.95, axis=1)
    i, j, found = hard_negatives.pairs_in_reach(a, b, low, high, 0)
    expected = {(x, y): scores[x, y] for x, y in zip(*np.nonzero((scores >= low[:, None]) & (scores <= high[:, None])), strict=True)}
    assert {(x, y): s for x, y, s in zip(i, j, found, strict=True)} == expected
    m, d = a.levels[1][0], a.levels[1][1]
    n, e = b.levels[1][0], b.levels[1][1]
    assert (np.abs(scores - m @ n.T) <= d @ e.T + 1e-6).all()
    assert (m @ n.T + d @ e.T < low[:, None]).mean() > 0.3  # they do rule out


def test_hard_negatives_of_large_scores(spark):
    """Scores beyond what doubles hold."""
    rows = [(i, i % 2, [float(2**22 + i), float(2**21 - 3 * i)]) for i in (0, 2, 4, 100, 101, 3, 5, 103)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert set(map(tuple, found.collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(100, 1, [0.1])], [(100, 1, []), (101, 1, []), (102, 2, [])], [(1, 1, [0.1]), (2, 2, [0.1])]):
        found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
        assert set(map(tuple, found.collect())) == plain_negatives(rows)


# 12 ------------------------------------------------------------------------------------------------------------------
def test_quality_classifier_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert rows.keys() == {r[0] for r in docs.select("doc_id").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.95 and np.mean([r["predicted"] == 0 for r, y in held if not y]) > 0.8
    assert np.mean([(r["score"] - y) ** 2 for r, y in held]) < 0.05


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = quality_model.fold(F.col("doc_id")) == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(docs, labels, features=32), quality_model.train(docs.withColumn("lang", F.lit("?")), other, features=32)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.shares, b.shares)


def test_fourier_features_approximate_a_gaussian_kernel():
    x = np.random.default_rng(0).standard_normal((40, 6))
    model = quality_model.untrained(np.zeros(6), np.ones(6), 20_000, 0.7)
    z = model.features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * 6 * 0.7**2))).max() < 0.05


def test_normal_equations_are_those_of_all_rows(spark):
    x = np.random.default_rng(3).standard_normal((300, quality_model.N_STATISTICS))
    y = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(5)
    both = lambda a, b: np.hstack([a, b[:, None]]).T @ np.hstack([a, b[:, None]])
    assert np.allclose(quality_model._summed(rows, both, quality_model.N_STATISTICS + 1), both(x, y.astype(float)))


def test_isotonic_is_the_best_rising_fit():
    random = np.random.default_rng(4)
    for _ in range(20):
        rows = random.integers(1, 5, 9).astype(float)
        ones = np.array([random.integers(0, n + 1) for n in rows.astype(int)], float)
        knots, shares = quality_model.isotonic(np.arange(9.0), rows, ones)
        assert (np.diff(shares) > 0).all() and (np.diff(knots) > 0).all()
        # the fit by the min-max formula: at each place the least, over ends, of the largest mean over beginnings
        best = [min(max(ones[a : b + 1].sum() / rows[a : b + 1].sum() for a in range(i + 1)) for b in range(i, 9)) for i in range(9)]
        assert np.allclose(sorted(set(np.round(best, 12))), np.round(shares, 12))


def test_statistics_are_of_whole_texts():
    plain = "the cat sat on the mat. " * 40_000
    assert np.isfinite(quality_model.statistics_of(["", " ", "\n", "x", "\x00", "é" * 9, plain, "\ud800", "a\r\n\tb"])).all()
    assert not np.allclose(quality_model.statistics(plain), quality_model.statistics(plain + "%%% &&& ### " * 100))


def test_quality_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text of no id", "c"), (4, "w " * 300_000, "d"), (4, "w " * 300_000, "d"), (5, "one", "e"), (6, "two", "f")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (4, None), (5, 7), (6, 1), (9, 1)], "doc_id long, quality int")
    assert {(r["text"], r["y"]) for r in quality_model.learnt_rows(docs, labels).collect()} == {(t, y) for i, t, y in ((1, "", 0), (6, "two", 1)) if zlib.crc32(str(i).encode()) % 5}
    rows = quality_model.score_documents(docs, quality_model.train(docs, labels, features=16)).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows) and [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    none = quality_model.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.score_documents(docs, none).collect()} == {0.5}
    assert not quality_model.score_documents(docs.limit(0), none).collect()


def test_learnt_rows_are_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = quality_model.learnt_rows(docs, docs.select("doc_id", F.lit(1).alias("quality")), most=400).count()
    assert 300 < n < 500


# 13 ------------------------------------------------------------------------------------------------------------------
def check_whitened(rows, found: list, most: int = 8) -> None:
    able = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(able), np.array([v for _, v in able], object)
    sums = x.sum(axis=0)
    centred = (x - np.array([Fraction(int(s), n) for s in sums])).astype(float)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    assert len(found) == n * len(values)
    by_component = {k: [r for r in found if r["component"] == k + 1] for k in range(len(values))}
    for k, e in enumerate(values):
        rows = by_component[k]
        assert len(rows) == n and all(r["n"] == n and abs(r["explained"] / (e / np.trace(covariance)) - 1) < 1e-9 for r in rows)
        expected = sorted(zip([i for i, _ in able], (n * x - sums) ** 2 @ np.ones(x.shape[1], int).astype(object), strict=True), key=str)
        assert sorted(((r["vec_id"], r["deviation"]) for r in rows), key=str) == expected
        own = centred @ vectors[:, k] / math.sqrt(e)
        got = {r["vec_id"]: r["whitened"] for r in rows}
        same = max(abs(got[i] - v) for (i, _), v in zip(able, own, strict=True))
        other = max(abs(got[i] + v) for (i, _), v in zip(able, own, strict=True))
        assert min(same, other) < 1e-9
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(rows, queries.op13_embedding_whitening(spark, DATA).collect())


def test_whitening_odd_rows(spark):
    rows = odd_vectors(spark).dropDuplicates(["vec_id"])
    check_whitened([(r["vec_id"], r["embedding"]) for r in rows.collect()], whitening.whitened_vectors(rows).collect())
    assert not whitening.whitened_vectors(rows.limit(0)).collect()
    assert not whitening.whitened_vectors(rows.filter("vec_id in (200, 201, 202)")).collect()  # equal vectors: no eigenvalue above zero
    twice = whitening.whitened_vectors(rows.union(rows)).collect()
    assert len(twice) == 2 * len(whitening.whitened_vectors(rows).collect()) and twice[0]["n"] == 2 * 139
    uneven = rows.select("vec_id", "embedding").union(spark.createDataFrame([(1, [1.0]), (2, [])], "vec_id long, embedding array<float>"))
    assert whitening.whitened_vectors(uneven).count() == whitening.whitened_vectors(rows).count()


def test_deviations_beyond_64_bits_are_null(spark):
    rows = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened_vectors(rows).filter("component = 1").collect()}
    assert found[1] is None and found[2] is None and found[3] is not None


MATRICES = {
    "random": lambda r: r.standard_normal((40, 20)), "equal values": lambda r: np.eye(7), "pairs": lambda r: np.diag([3.0, 3.0, 1.0, 1.0, 0.0, 0.0]) ** 0.5,
    "one": lambda r: np.array([[2.0]]), "rank one": lambda r: np.ones((1, 5)), "close values": lambda r: np.diag(np.sqrt(1 + 1e-12 * np.arange(9))) @ np.linalg.qr(r.standard_normal((9, 9)))[0],
    "zero": lambda r: np.zeros((3, 4)), "large and small": lambda r: r.standard_normal((50, 12)) * 10.0 ** np.arange(-6, 6),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading_components(name):
    b = MATRICES[name](np.random.default_rng(1))
    a = b.T @ b
    values, vectors = whitening.leading_components(a)
    expected = np.linalg.eigvalsh(a)[::-1][:8]
    norm = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - expected[: len(values)]).max(initial=0) < 1e-13 * norm and (expected[len(values) :] < 1e-12 * norm).all()
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-13
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) < 1e-13 * norm

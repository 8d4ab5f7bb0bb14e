"""Algorithms for long histories, many pairs and large groups against plain versions."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantmill import registry
from quantmill.functions.durable import written
from quantmill.operators import hedge, panel, signals, tiles

RNG = np.random.default_rng(5)


def long_pair(spark, n: int, name: str = "B"):
    x = np.cumsum(RNG.normal(0, 0.001, n)) + 4
    y = 0.2 + 1.1 * x + RNG.normal(0, 0.01, n)
    return spark.createDataFrame(pd.DataFrame({"symbol_y": "A", "symbol_x": name, "pos": range(n), "price_y": np.exp(y), "price_x": np.exp(x)}))


def test_long_pairs_are_screened_as_their_windows_are(spark):
    """Over 8,100 rows the lag rule gives more than 36 lags, and a pair's rows are several blocks."""
    rows = long_pair(spark, 9000).union(long_pair(spark, 300, "C"))
    a, b = ({r["symbol_x"]: r.asDict() for r in f(rows).collect()} for f in (hedge.screen, hedge.screen_windows))
    for k in "BC":
        assert {c: v if not isinstance(v, float) else pytest.approx(v, rel=1e-6, abs=1e-12) for c, v in b[k].items()} == a[k]
    assert hedge.adf(hedge.ols_spread(rows)).count() == 2


def test_half_life_and_hurst_from_sums_equal_windows(spark):
    rows = hedge.ols_spread(long_pair(spark, 2500).union(long_pair(spark, 60, "C")))
    got = {r["symbol_x"]: r for r in hedge.screen(rows.select("symbol_y", "symbol_x", "pos", "price_y", "price_x"), minimum=40).collect()}
    for name, table in (("half_life", hedge.half_life(rows)), ("hurst", hedge.hurst(rows))):
        assert {r["symbol_x"]: pytest.approx(r[name], rel=1e-7) for r in table.collect()} == {k: r[name] for k, r in got.items()}


def seconds(df) -> float:
    df.write.format("noop").mode("overwrite").save()
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_folds_take_time_in_proportion(spark):
    """A 20,000-row pair takes about twice the time of a 10,000-row one, not four times."""
    rules = signals.Rules(1.5, 0.5, 2.5, 10, 2)
    for fold in (hedge.kalman, lambda d: signals.trade_signals(d, rules), lambda d: signals.filled_signals(d, rules)):
        took = []
        for n in (10_000, 40_000):
            z = spark.createDataFrame(pd.DataFrame({"pos": range(n), "zscore": RNG.normal(0, 1.5, n), "tradable": RNG.random(n) < 0.7, "sized": True}))
            took.append(seconds(fold(written(long_pair(spark, n).join(z, "pos")))))
        assert took[1] < 6 * took[0] + 1, took


def test_kalman_hands_its_state_from_batch_to_batch(spark):
    rows = long_pair(spark, 500).union(long_pair(spark, 300, "C"))
    whole = {tuple(r) for r in hedge.kalman(rows).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert {tuple(r) for r in hedge.kalman(rows).collect()} == whole and len(whole) == 800
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("symbols, dates", [(3, 16), (256, 1024)])
def test_tiles_equal_pair_regressions(spark, symbols, dates):
    groups = {f"S{i:02d}": [None, "g", "h"][i % 3] for i in range(14)}
    prices = {s: {d: float(np.exp(RNG.normal(2, 0.1))) for d in range(70) if RNG.random() < 0.6 or s == "S00"} for s in groups}
    prices["S04"] = dict.fromkeys(range(70), 5.0)  # a constant
    prices["S07"] = {3: 1.0, 4: 2.0}
    rows = spark.createDataFrame([(s, d, v) for s, p in prices.items() for d, v in p.items()] + [("S01", 99, None)], "symbol string, day int, price double")
    rows = rows.select("symbol", F.date_add(F.lit("1969-12-01").cast("date"), F.col("day")).alias("date"), "price")
    universe = spark.createDataFrame(list(groups.items()), "symbol string, group_name string")
    got = {(r["symbol_y"], r["symbol_x"]): r for r in tiles.all_pairs_ols(rows, universe, symbols=symbols, dates=dates).collect()}
    expected = {}
    for a, b in itertools.combinations(sorted(groups), 2):
        common = sorted(prices[a].keys() & prices[b].keys())
        if groups[a] == groups[b] and len(common) >= 3 and b != "S04":
            y, x = (np.log([prices[s][d] for d in common]) for s in (a, b))
            slope = np.polyfit(x, y, 1)
            expected[a, b] = len(common), slope[1], slope[0], np.sqrt(((y - np.polyval(slope, x)) ** 2).sum() / (len(common) - 1))
    assert got.keys() == expected.keys()
    for k, (n, alpha, beta, deviation) in expected.items():
        r = got[k]
        assert r["n"] == n and (r["alpha"], r["beta"], r["spread_standard_deviation"]) == (pytest.approx(alpha), pytest.approx(beta, abs=1e-9), pytest.approx(deviation, abs=1e-9))
    assert not tiles.all_pairs_ols(rows.limit(0), universe).collect()


def shuffles_of_pairs(df) -> int:
    """Shuffles after the tiles, which would hold rows of pairs."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan[: plan.index("FlatMapGroupsInArrow")].count("Aggregate") + plan[: plan.index("FlatMapGroupsInArrow")].count("Window")


def test_tiles_keep_pair_rows_in_their_task(spark):
    """However many blocks, strips of dates and rows there are: regressions come whole out of a tile."""
    assert not shuffles_of_pairs(registry.queries()["H01_all_pairs"](spark, "/root/testdata/sf0.001"))


def test_blocks_do_not_grow_with_symbols(spark):
    """A price travels once for each block: 12 of them, until a block has 8,192 symbols."""
    for n, copies in ((3_000, 12), (6_000, 12), (120_000, 15)):
        universe = spark.range(n).select(F.format_string("S%06d", "id").alias("symbol"), F.lit("g").alias("group_name"))
        prices = spark.range(10).select(F.format_string("S%06d", "id").alias("symbol"), F.lit("2020-01-01").alias("date"), F.lit(2.0).alias("price"))
        assert tiles._tiles(prices, universe, tiles.SYMBOLS).count().agg(F.sum("count")).first()[0] == 10 * copies


def test_all_pairs_zscores_shuffle_no_pair_rows(spark):
    assert not shuffles_of_pairs(registry.queries()["W01_all_pairs"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("symbols, dates", [(3, 16), (256, 1024)])
def test_last_zscores_of_tiles_equal_windows(spark, symbols, dates):
    """Also where all or some of the windows of a spread are constant, and where a pair has too few rows."""
    groups = {f"S{i:02d}": [None, "g"][i % 2] for i in range(12)}
    walk = lambda: float(np.exp(RNG.normal(2, 0.1)))
    prices = {s: {d: walk() for d in range(80) if RNG.random() < 0.7 or s == "S00"} for s in groups}
    prices["S04"] = dict(prices["S00"])  # the same series
    prices["S06"] = {d: v * (1.0 if d < 50 else 1.0 + d / 100) for d, v in prices["S00"].items()}
    prices["S03"] = {d: 3.0 if d < 40 else walk() for d in range(80)}  # with S05, a spread that rests
    prices["S05"] = {d: 5.0 if d < 40 else walk() for d in range(80)}
    prices["S07"] = {d: walk() for d in range(10)}
    rows = spark.createDataFrame([(s, d, v) for s, p in prices.items() for d, v in p.items()], "symbol string, day int, price double")
    rows = rows.select("symbol", F.date_add(F.lit("1969-12-01").cast("date"), F.col("day")).alias("date"), "price")
    universe = spark.createDataFrame(list(groups.items()), "symbol string, group_name string")
    got = {(r["symbol_y"], r["symbol_x"]): r for r in tiles.all_pairs_last_zscore(rows, universe, 12, symbols=symbols, dates=dates).collect()}
    plain = signals.standardise(hedge.ols_spread(panel.pair_panel(panel.candidate_pairs(universe), rows)), 12).filter("zscore is not null")
    expected = {(r["symbol_y"], r["symbol_x"]): r for r in plain.groupBy("symbol_y", "symbol_x").agg(F.count("*").alias("rows"), F.max("date").alias("date"), F.max_by("zscore", "pos").alias("zscore")).collect()}
    assert got.keys() == expected.keys() and ("S00", "S04") not in got and len(got) > 15
    for k, r in expected.items():
        assert (got[k]["rows"], got[k]["date"], got[k]["zscore"]) == (r["rows"], r["date"], pytest.approx(r["zscore"], abs=1e-7)), k
    assert got["S03", "S05"]["rows"] < 80 - 12
    assert not tiles.all_pairs_last_zscore(rows.limit(0), universe, 12).collect()


def test_large_groups_write_a_block_once(spark, monkeypatch):
    """Prices of a group over TRAVELS symbols do not travel to tiles, and results are those of prices that do."""
    symbols = spark.range(tiles.SYMBOLS * 4 + 1).select(F.format_string("S%06d", "id").alias("symbol"))
    plan = tiles.all_pairs_ols(symbols.select("symbol", F.lit("2020-01-01").alias("date"), F.lit(2.0).alias("price")), symbols.withColumn("group_name", F.lit("g")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan

    groups = {f"S{i:02d}": [None, "g", "g", "h"][i % 4] for i in range(40)} | {"T0": "small", "T1": "small"}
    rows = [(s, d, float(np.exp(RNG.normal(2, 0.1)))) for s in groups for d in range(60) if RNG.random() < 0.8]
    rows = spark.createDataFrame(rows, "symbol string, day int, price double").select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("date"), "price")
    universe = spark.createDataFrame(list(groups.items()), "symbol string, group_name string")

    def results():
        out = [f(rows, universe).collect() for f in (tiles.all_pairs_ols, lambda *a: tiles.all_pairs_last_zscore(*a, 12))]
        return [{tuple(r[:3]): [v if not isinstance(v, float) else pytest.approx(v, rel=1e-9, abs=1e-12) for v in r[3:]] for r in x} for x in out]

    travelled = [{k: [getattr(v, "expected", v) for v in r] for k, r in x.items()} for x in results()]
    assert [len(x) for x in travelled] == [45 + 190 + 45 + 1] * 2
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(tiles, "TRAVELS", 5)
    monkeypatch.setattr(tiles, "NEIGHBOURS", 9)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # several blocks of a group and a partition
        assert results() == travelled
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_last_zscores_make_few_rows():
    """Rows of a spread that no z-score needs are not made: z-scores take less than 9 times as long as to look up all partners' prices."""
    parts = []
    for k in range(2):
        day = [np.flatnonzero(RNG.random(2500) < 0.21).astype(np.int32) for _ in range(256)]
        v = [RNG.normal(2, 0.1, len(d)) for d in day]
        parts.append(tiles.pa.table({"symbol": [f"S{k}{i:03d}" for i in range(256)], "day": tiles.pa.array(day, tiles.pa.list_(tiles.pa.int32())), "v": tiles.pa.array(v, tiles.pa.list_(tiles.pa.float64()))}))
    blocks, days = tiles._blocks(parts)
    (fits,) = tiles._fits(blocks, days, 20, 256, 256, 1024)
    took = [[], []]
    for _ in range(3):
        began = time.thread_time()
        for k in range(256):
            fits.values.take(blocks[0].at[blocks[0].bounds[k] : blocks[0].bounds[k + 1]], axis=1)
        middle = time.thread_time()
        assert len(tiles._last_zscores(fits, 60)[0]) > 60_000
        took[0].append(middle - began)
        took[1].append(time.thread_time() - middle)
    assert min(took[1]) < 9 * min(took[0]), took

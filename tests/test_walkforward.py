"""The walk-forward and the grid on a small market with holes, against plain loops over its rows."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.functions.durable import written
from quantmill.operators import grid, hedge, inference, panel, signals, walkforward
from quantmill.sources import prices as sources

FORMATION, TRADING, CAPITAL, NOTIONAL, DAYS = 60, 20, 100_000.0, 5_000.0, 175
GROUPS = {"A": "g", "B": "g", "C": "g", "D": "h", "E": "h"}
SCENARIOS = [("base", 1.0, 0.25, 12, True), ("wide", 1.6, 0.25, 12, False), ("long", 1.0, 0.25, 25, False), ("both", 1.6, 0.5, 25, False)]


def market() -> dict[str, dict[int, float]]:
    """Prices by symbol and day: C follows A, B runs against A, D and E wander; a seventh of the days is missing, F mostly."""
    rng = random.Random(11)
    out, level, gap = {s: {} for s in "ABCDEF"}, 4.0, 0.0
    walks = {"D": 3.0, "E": 3.5, "F": 2.0}
    for day in range(DAYS):
        level += rng.gauss(0, 0.02)
        gap = 0.5 * gap + rng.gauss(0, 0.03)
        prices = {"A": level, "C": 0.3 + 0.9 * level + gap, "B": 8 - level + rng.gauss(0, 0.01)}
        for s in walks:
            walks[s] += rng.gauss(0, 0.03)
        for s, v in {**prices, **walks}.items():
            if rng.random() > (0.6 if s == "F" else 0.14) and not (s == "B" and 90 <= day < 95):
                out[s][day] = math.exp(v)
    return out


def plain_marks(prices: dict, limit: int = 3, coverage: float = 0.7) -> tuple[list[int], dict]:
    """Days on which every symbol kept has a mark, and (price, observed) by symbol and day."""
    days = sorted({d for p in prices.values() for d in p})
    place = {d: i for i, d in enumerate(days)}
    kept = [s for s, p in prices.items() if len(p) / len(days) >= coverage]
    marks = {}
    for s in kept:
        last = None
        for d in days:
            last = d if d in prices[s] else last
            if last is not None and place[d] - place[last] <= limit:
                marks[s, d] = (prices[s][last], d in prices[s])
    return [d for d in days if all((s, d) in marks for s in kept)], marks


def plain_screen(marks: dict, days: list[int], first: int, last: int) -> tuple | None:
    """The rank-1 pair of a formation window: (y, x, alpha, beta)."""
    found = []
    for y in GROUPS:
        for x in GROUPS:
            if y < x and GROUPS[y] == GROUPS[x]:
                a, b = (np.log([marks[s, d][0] for d in days[first : last + 1]]) for s in (y, x))
                alpha, beta, _, _, p, _, _, half, hurst = hedge.window_figures(a, b)
                assert beta == pytest.approx(np.polyfit(b, a, 1)[0])
                found.append([p if p is not None else 1.0, y, x, alpha, beta, half, hurst])
    found.sort(key=lambda r: r[:3])
    corrected = [min(1.0, min(q[0] * len(found) / (j + 1) for j, q in enumerate(found) if j >= i)) for i in range(len(found))]
    fine = [(c, r[5], r[1], r[2], r[3], r[4]) for c, r in zip(corrected, found, strict=True) if c <= 0.05 and r[4] > 0 and r[5] and 0 < r[5] <= 60 and r[6] is not None and r[6] < 0.5]
    return min(fine)[2:] if fine else None


def plain_trades(z: list, tradable: list[bool], entry: float, exit_: float, stop: float) -> list[tuple[int, bool]]:
    """(side held, whether a fill happened) by row; decisions are due a row later and wait for rows that can be traded."""
    side, want, waiting, just_closed, out = 0, 0, [], False, []
    for t, v in enumerate(z):
        filled = False
        if waiting and tradable[t] and not (t == len(z) - 1 and side == 0):
            side, filled = waiting.pop(0), True
        just_closed = filled and side == 0
        if not just_closed and v is not None:
            if side and want == side and (v * side <= -stop or v * side >= -exit_):
                want = 0
                waiting.append(0)
            elif not side and want and v * want >= -exit_:
                want, waiting = 0, []  # the entry that waits is called off
            elif not side and not want and abs(v) >= entry:
                want = -1 if v > 0 else 1
                waiting.append(want)
        out.append((side, filled))
    return out


def plain_fold(marks: dict, days: list[int], fold: int, scenario: tuple) -> tuple[str, list]:
    """Status and returns of the trading rows of a fold."""
    _, entry, exit_, lookback, _ = scenario
    first = fold * TRADING
    chosen = plain_screen(marks, days, first, first + FORMATION - 1)
    if chosen is None:
        return "NO_SELECTION", [0.0] * TRADING
    y, x, alpha, beta = chosen
    rows = range(first + FORMATION, first + FORMATION + TRADING)
    spread = {t: math.log(marks[y, days[t]][0]) - alpha - beta * math.log(marks[x, days[t]][0]) for t in range(first, rows[-1] + 1)}
    z = []
    for t in rows:
        before = [spread[k] for k in range(t - lookback, t)]
        z.append((spread[t] - np.mean(before)) / np.std(before, ddof=1))
    tradable = [marks[y, days[t]][1] and marks[x, days[t]][1] for t in rows]
    states = plain_trades(z, tradable, entry, exit_, 3.5)
    equity, units, returns = CAPITAL, (0.0, 0.0), []
    for t, (side, filled) in zip(rows, states, strict=True):
        price = marks[y, days[t]][0], marks[x, days[t]][0]
        if returns:
            before = marks[y, days[t - 1]][0], marks[x, days[t - 1]][0]
            pnl = units[0] * (price[0] - before[0]) + units[1] * (price[1] - before[1])
        else:
            pnl = 0.0
        if filled:
            units = (side * NOTIONAL / (1 + beta) / price[0], -side * NOTIONAL * beta / (1 + beta) / price[1])
        returns.append(pnl / equity)
        equity += pnl
    return "COMPLETED", returns


@pytest.fixture(scope="module")
def plain():
    days, marks = plain_marks(market())
    n = (len(days) - FORMATION - TRADING) // TRADING + 1
    return days, marks, {s[0]: [plain_fold(marks, days, k, s) for k in range(n)] for s in SCENARIOS}


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(s, d, v) for s, p in market().items() for d, v in p.items()]
    prices = spark.createDataFrame(rows, "symbol string, day int, price double").select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("date"), "price")
    clean = sources.clean(prices, 0.7, 3)
    dates = {r[0]: i for i, r in enumerate(clean.select("date").distinct().orderBy("date").collect())}
    return written(clean.join(spark.createDataFrame(list(dates.items()), "date date, pos long"), "date"))


@pytest.fixture(scope="module")
def pairs_panel(spark, marks):
    universe = spark.createDataFrame(list(GROUPS.items()), "symbol string, group_name string")
    dates = marks.select("date", F.col("pos").alias("at")).distinct()
    return written(panel.pair_panel(panel.candidate_pairs(universe), marks.drop("pos")).drop("pos").join(dates, "date").withColumnRenamed("at", "pos"))


@pytest.fixture(scope="module")
def scenarios(spark):
    rows = [(name, e, x, 3.5, z, FORMATION, TRADING, base, "COMPLETED") for name, e, x, z, base in SCENARIOS]
    return spark.createDataFrame(rows, "scenario_id string, entry_z double, exit_z double, stop_z double, zscore_lookback int, formation_window int, trading_window int, is_baseline boolean, status string")


@pytest.fixture(scope="module")
def run(spark, plain, pairs_panel, scenarios):
    folds = grid.scenario_folds(scenarios, len(plain[0]))
    return walkforward.run_grid(pairs_panel, scenarios, folds, [12, 25], minimum=50, target=NOTIONAL, capital=CAPITAL)


def test_marks_carry_over_holes(marks, plain):
    days, own, _ = plain
    got = {(r["symbol"], r["pos"]): (r["price"], r["observed"]) for r in marks.collect()}
    assert got == {(s, i): own[s, d] for i, d in enumerate(days) for s in GROUPS} and len(days) < DAYS
    assert any(not observed for _, observed in got.values())


def test_grid_equals_plain_loops(run, plain):
    statuses, moved = set(), 0
    got = {(r["scenario_id"], r["fold_id"], r["pos"]): (r["status"], r["r"]) for r in run[0].collect()}
    assert len(got) == sum(len(f) * TRADING for f in plain[2].values())
    for name, folds in plain[2].items():
        for k, (status, returns) in enumerate(folds):
            statuses.add(status)
            for i, r in enumerate(returns):
                own = got[name, k, FORMATION + k * TRADING + i]
                assert own[0] == status and own[1] == pytest.approx(r, abs=1e-12), (name, k, i)
                moved += r != 0
    assert statuses == {"COMPLETED", "NO_SELECTION"} and moved > 50


def test_one_walk_equals_its_scenario(spark, run, pairs_panel, plain):
    folds = panel.folds(spark.createDataFrame([(len(plain[0]),)], "n long"), FORMATION, TRADING)
    screened, traded = walkforward.run_folds(pairs_panel, folds, signals.Rules(1.0, 0.25, 3.5), 12, minimum=50, target=NOTIONAL, capital=CAPITAL)
    status = walkforward.fold_status(folds, screened.filter("corrected_p is not null"), traded)
    rows = {(r["fold_id"], r["pos"]): r["r"] for r in walkforward.calendar_returns(status, traded).collect()}
    assert rows == {(r["fold_id"], r["pos"]): pytest.approx(r["r"]) for r in run[0].filter("scenario_id = 'base'").collect()}
    counts = walkforward.coverage(walkforward.calendar_returns(status, traded)).first()
    own = [s for s, _ in plain[2]["base"]]
    assert (counts["folds"], counts["completed"], counts["no_selection"], counts["coverage"]) == (len(own), own.count("COMPLETED"), own.count("NO_SELECTION"), 1.0)


def test_reports_on_the_common_horizon(spark, run, scenarios, plain):
    rows = grid.common_horizon(run[0], scenarios)
    report = {r["scenario_id"]: r for r in walkforward.return_report(rows, ("scenario_id",)).collect()}
    for name, folds in plain[2].items():
        r = np.array([v for _, returns in folds for v in returns])
        equity = np.cumprod(1 + r)
        assert report[name]["total_return"] == pytest.approx(equity[-1] - 1) and report[name]["complete"]
        assert report[name]["maximum_drawdown"] == pytest.approx(min(0, (equity / np.maximum.accumulate(np.maximum(equity, 1)) - 1).min()))
        z = inference.probabilistic_sharpe(rows.filter(F.col("scenario_id") == name), 0.0, ("scenario_id",)).first()
        s, n = r.mean() / r.std(ddof=1), len(r)
        d = (r - r.mean()) / r.std()
        g1, g2 = (d**3).mean(), (d**4).mean() - 3
        skew, kurt = g1 * math.sqrt(n * (n - 1)) / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
        assert z["p"] == pytest.approx(1 - NormalDist().cdf(s * math.sqrt(n - 1) / math.sqrt(1 - skew * s + (kurt - 1) / 4 * s * s)), rel=1e-6)


def test_summary_counts_eligible_scenarios(spark, scenarios):
    common = spark.createDataFrame([("base", 0.1, 1.0, -0.1), ("wide", -0.1, -1.0, -0.3), ("long", 0.2, 2.0, -0.05)], "scenario_id string, total_return double, sharpe_ratio double, maximum_drawdown double")
    variants = scenarios.filter("scenario_id in ('wide', 'long')")
    status = lambda **s: scenarios.withColumn("status", F.coalesce(*[F.when(F.col("scenario_id") == k, v) for k, v in s.items()], F.col("status")))
    full = grid.sensitivity_summary(status(both="INVALID"), common, variants).first()
    assert full["headline"] and (full["eligible"], full["defined"], full["invalid"]) == (3, 3, 1) and full["variant_sign_agreement"] == 0.5 and full["positive_share"] == pytest.approx(2 / 3)
    assert full["mild_drawdown_share"] == pytest.approx(2 / 3) and full["baseline_total_return"] == 0.1 and full["variant_positive_sharpe_share"] == 0.5
    part = grid.sensitivity_summary(scenarios, common, variants).first()  # ``both`` is eligible and has no figures
    assert not part["headline"] and part["baseline_total_return"] is None and part["defined"] == 3 and part["eligible"] == 4
    none = grid.sensitivity_summary(status(base="INVALID", wide="FAILED", long="INVALID", both="INVALID"), common, variants).first()
    assert not none["headline"] and none["eligible"] == 0 and none["failed"] == 1
    assert not grid.sensitivity_summary(scenarios.limit(0), common, variants).first()["headline"]


def test_common_horizon_of_scenarios_with_other_schedules(spark, scenarios):
    rows = spark.createDataFrame([(s, p, None if p == 4 else 0.1) for s, ps in {"base": range(2, 7), "wide": range(4, 9), "long": range(8, 9)}.items() for p in ps], "scenario_id string, pos long, r double")
    got = grid.common_horizon(rows, scenarios.withColumn("status", F.when(F.col("scenario_id") == "long", "FAILED").otherwise(F.col("status"))))
    assert sorted((r["scenario_id"], r["pos"]) for r in got.collect()) == [(s, p) for s in ("base", "wide") for p in (4, 5, 6)]  # unknown returns count, failed and empty scenarios do not
    assert not grid.common_horizon(rows, scenarios).collect()


def test_unknown_p_stays_unknown(spark):
    tests = spark.createDataFrame([("a", 0.01, "COMPLETED"), ("b", None, "INCOMPLETE"), ("c", 0.02, "COMPLETED"), ("d", 0.9, "COMPLETED")], "scenario_id string, p double, status string")
    got = {r["scenario_id"]: r for r in inference.multiplicity(tests).collect()}
    assert (got["b"]["bonferroni_p"], got["b"]["bh_p"], got["b"]["bonferroni_discovery"], got["b"]["bh_discovery"]) == (None, None, None, None)
    assert got["a"]["bonferroni_p"] == 0.04 and got["a"]["bh_p"] == pytest.approx(0.04) and got["a"]["bonferroni_discovery"]
    counts = inference.multiplicity_counts(inference.multiplicity(tests)).first()
    assert (counts["configurations"], counts["eligible"], counts["known_p"], counts["unavailable"], counts["raw_exceedances"], counts["bonferroni_exceedances"], counts["bh_discoveries"]) == (4, 4, 3, 1, 2, 1, 2)
    nothing = inference.multiplicity(tests.withColumn("p", F.lit(None).cast("double")))
    assert {(r["bonferroni_p"], r["bh_p"]) for r in nothing.collect()} == {(None, None)} and not inference.multiplicity(tests.limit(0)).collect()


@pytest.mark.parametrize("n", [1, 7, 500])
def test_ranks_by_ranges_equal_one_window(spark, n):
    rng = random.Random(n)
    p = [None if rng.random() < 0.1 else round(rng.random() ** 3, 2) for _ in range(n)]
    tests = spark.createDataFrame(list(enumerate(p)), "id int, p double").repartition(3)
    got = {r["id"]: r["corrected_p"] for r in hedge.benjamini_hochberg(tests, "p", (), ("id",)).collect()}
    one = {r["id"]: r["corrected_p"] for r in hedge.benjamini_hochberg(tests.withColumn("k", F.lit(1)), "p", ("k",), ("id",)).collect()}
    order = sorted((v, i) for i, v in enumerate(p) if v is not None)
    for k, (v, i) in enumerate(order):
        assert got[i] == pytest.approx(min(1.0, min(w * len(order) / (j + 1) for j, (w, _) in enumerate(order) if j >= k)))
    assert {i: v if v is None else pytest.approx(v) for i, v in one.items()} == got

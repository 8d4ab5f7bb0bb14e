"""Operators without SQL against plain versions, and causality: later rows never change earlier results."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.functions import durable
from quantmill.operators import accounting, grid, hedge, inference, ledger, metrics, panel, positions, quality, signals, walkforward
from quantmill.plans import catalog_core, catalog_research
from quantmill.sources import store
from quantmill.sources import prices as sources

DATA = "/root/testdata/sf0.001"
RNG = np.random.default_rng(21)


def pair_rows(spark, y, x):
    return spark.createDataFrame([("A", "B", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "symbol_y string, symbol_x string, pos long, price_y double, price_x double")


def exact_pair(n=80):
    x = np.linspace(3.5, 4.5, n)
    return np.exp(0.35 + 1.4 * x), np.exp(x)


def test_ols_recovers_an_exact_relation(spark):
    fit = hedge.ols(pair_rows(spark, *exact_pair())).first()
    assert fit["alpha"] == pytest.approx(0.35) and fit["beta"] == pytest.approx(1.4)
    assert hedge.ols(pair_rows(spark, [1, 2, 3], [5, 5, 5])).count() == 0


def test_kalman_is_causal_and_tracks(spark):
    x = np.exp(np.cumsum(RNG.normal(0, 0.02, 200)) + 4)
    y = np.exp(0.2 + 1.15 * np.log(x) + RNG.normal(0, 0.01, 200))
    whole = {r["pos"]: r for r in hedge.kalman(pair_rows(spark, y, x)).collect()}
    part = {r["pos"]: r for r in hedge.kalman(pair_rows(spark, y[:120], x[:120])).collect()}
    assert all(part[i]["beta"] == whole[i]["beta"] for i in part)
    first = whole[0]
    h = np.array([1.0, math.log(x[0])])
    assert first["innovation"] == pytest.approx(math.log(y[0]) - math.log(x[0])) and first["innovation_variance"] == pytest.approx(h @ h + 1e-3)


def plain_unit_root(s, constant, longest):
    change = np.diff(s)

    def design(k, skip):
        rows = range(skip + 1, len(s))
        return np.array([[s[t - 1], *([1.0] if constant else []), *(change[t - 1 - j] for j in range(1, k + 1))] for t in rows]), np.array([change[t - 1] for t in rows])

    def fit(k, skip):
        a, b = design(k, skip)
        c, *_ = np.linalg.lstsq(a, b, rcond=None)
        rss = float(((b - a @ c) ** 2).sum())
        return c[0] / math.sqrt(rss / (len(b) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0]), rss, len(b), a.shape[1]

    def aic(k):
        _, rss, n, p = fit(k, longest)
        return n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * p

    best = min(range(longest + 1), key=aic)
    return fit(best, best)[0], best


@pytest.mark.parametrize("constant", [True, False])
def test_unit_root_equals_least_squares(spark, constant):
    for phi in (0.5, 0.95):
        s = [0.0]
        for e in RNG.normal(0, 1, 240):
            s.append(phi * s[-1] + e)
        rows = spark.createDataFrame([("A", "B", i, float(v)) for i, v in enumerate(s)], "symbol_y string, symbol_x string, pos long, spread double").repartition(3)
        got = hedge.unit_root(rows, constant=constant, series=1 if constant else 2).first()
        statistic, lags = plain_unit_root(s, constant, hedge.max_lag(len(s), constant))
        assert got["lags"] == lags and got["statistic"] == pytest.approx(statistic, rel=1e-6)


def test_mackinnon_surfaces():
    assert hedge.mackinnon_p(-2.86, 1) == pytest.approx(0.05, abs=0.001) and hedge.mackinnon_p(-3.337, 2) == pytest.approx(0.05, abs=0.001)
    assert (hedge.mackinnon_p(-30, 1), hedge.mackinnon_p(3, 1)) == (0.0, 1.0)
    for series, tau in hedge.TAU_STAR.items():
        assert hedge.mackinnon_p(tau, series) == pytest.approx(hedge.mackinnon_p(tau + 1e-9, series), abs=0.001)


def test_screening_family_and_ranks(spark):
    rows = []
    for name, (phi, noise) in {"X1": (0.2, 0.02), "X2": (0.4, 0.02), "X3": (1.0, 0.05)}.items():
        x, s = np.cumsum(RNG.normal(0, 0.02, 260)) + 4, [0.0]
        for e in RNG.normal(0, noise, 259):
            s.append(phi * s[-1] + e)
        rows += [("A", name, i, float(np.exp(x[i] + s[i])), float(np.exp(x[i]))) for i in range(260)]
    rows += [("A", "X4", i, 1.0 + i, 2.0) for i in range(260)] + [("A", "X5", i, 1.0 + i, 2.0 + i) for i in range(20)]
    got = {r["symbol_x"]: r for r in hedge.screen(spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, price_y double, price_x double")).collect()}
    assert got["X4"]["rejection_reasons"] == ["degenerate_prices"] and got["X5"]["rejection_reasons"] == ["insufficient_observations"]
    assert {got["X1"]["rank"], got["X2"]["rank"]} == {1, 2} and not got["X3"]["selected"] and got["X1"]["corrected_p"] < 0.05


def states(spark, zscores, rules):
    rows = spark.createDataFrame([("A", "B", 3 * i, None if z is None else float(z)) for i, z in enumerate(zscores)], "symbol_y string, symbol_x string, pos long, zscore double")
    return signals.trade_signals(rows, rules).orderBy("pos").collect()


def fills(spark, rows, rules, **options):
    facts = [("A", "B", i, None if z is None else float(z), a, b) for i, (z, a, b) in enumerate(rows)]
    return signals.filled_signals(spark.createDataFrame(facts, "symbol_y string, symbol_x string, pos long, zscore double, tradable boolean, sized boolean"), rules, **options).orderBy("pos").collect()


def test_signal_clocks(spark):
    rows = states(spark, [0, -2, None, -1, -1, -3, -3, -2, -0.5, None], signals.Rules(2, 0.5, 3.5, 3, 2))
    assert [r["event"] for r in rows] == ["NONE", "ENTER_LONG", "NONE", "NONE", "EXIT_TIME", "NONE", "NONE", "ENTER_LONG", "EXIT_MEAN_REVERSION", "NONE"]
    assert [r["holding_period"] for r in rows] == [0, 0, 1, 2, 3, 0, 0, 0, 1, 0] and [r["cooldown_remaining"] for r in rows] == [0, 0, 0, 0, 2, 2, 1, 0, 2, 2]
    assert [r["event"] for r in states(spark, [2, 3.5, 0], signals.Rules(2, 0.5, 3.5))] == ["ENTER_SHORT", "EXIT_STOP", "NONE"]


def test_filled_states_follow_fills(spark):
    rules = signals.Rules(2, 0.5, 3.5, None, 1)
    ok, no = (True, True), (False, True)
    rows = fills(spark, [(-2, *ok), (-2, *no), (-2, True, False), (-2, *ok), (0, *ok), (-2, *no), (-2, *ok), (-2, *ok), (-2, *ok)], rules)
    assert [r["execution_event"] for r in rows] == ["NONE", "NONE", "NONE", "ENTER_LONG", "NONE", "NONE", "EXIT_MEAN_REVERSION", "NONE", "NONE"]
    due = lambda r: (r["execution_decision_row"], r["execution_due_row"])
    assert due(rows[3]) == (0, 1) and due(rows[6]) == (4, 5) and [rows[i]["event"] for i in (6, 7, 8)] == ["NONE", "NONE", "ENTER_LONG"]
    assert [r["holding_period"] for r in rows] == [0, 0, 0, 0, 1, 2, 3, 0, 0] and [r["cooldown_remaining"] for r in rows] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    called_off = fills(spark, [(-2, *ok), (0, *no), (0, *ok), (-2, *ok)], rules)
    assert [r["execution_event"] for r in called_off] == ["NONE"] * 4 and called_off[1]["event"] == "EXIT_MEAN_REVERSION" and called_off[3]["event"] == "ENTER_LONG"
    assert fills(spark, [(-2, *ok), (-2, *ok)], rules, suppress_last=True)[1]["execution_event"] == "NONE"
    late = fills(spark, [(-2, *ok), (-2, *ok), (0, *ok), (0, *ok), (0, *ok)], rules, lag=2)  # called off too late: the entry is filled, then closed
    assert [r["execution_event"] for r in late] == ["NONE", "NONE", "ENTER_LONG", "NONE", "EXIT_MEAN_REVERSION"]


def test_filled_states_are_causal(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 2), rng.random() < 0.7, rng.random() < 0.8) for _ in range(300)]
    rules = signals.Rules(1.5, 0.5, 3, 8, 2)
    out = fills(spark, rows, rules)
    assert out[:200] == fills(spark, rows[:200], rules)
    for row, (_, tradable, sized) in zip(out, rows):
        assert row["execution_event"] == "NONE" or (tradable and (sized or row["execution_event"].startswith("EXIT")))
    actual = 0
    for row in out:  # fills alternate, and each has a decision before it
        if row["execution_event"] != "NONE":
            assert row["execution_event"].startswith("EXIT") == (actual != 0) and row["execution_due_row"] <= row["pos"]
            assert out[row["execution_decision_row"]]["event"] == row["execution_event"]
            actual = 0 if actual else 1


def test_open_loop_fills(spark):
    plan = [("ENTER_LONG", 1, 1), ("NONE", 0, 1), ("NONE", 1, 0), ("EXIT_STOP", 1, 1), ("ENTER_SHORT", 0, 1), ("NONE", 1, 1), ("EXIT_TIME", 1, 1), ("NONE", 0, 1), ("ENTER_LONG", 1, 1), ("NONE", 0, 0), ("EXIT_STOP", 0, 1), ("ENTER_LONG", 1, 0), ("NONE", 1, 1)]
    rows = spark.createDataFrame([("A", "B", i, e, bool(t), bool(s)) for i, (e, t, s) in enumerate(plan)], "symbol_y string, symbol_x string, pos long, event string, tradable boolean, sized boolean")
    got = [(r["execution_event"], r["execution_decision_row"]) for r in signals.open_loop_fills(rows).orderBy("pos").collect()]
    # 0 is filled in row 3 (not tradable, not sized before), its exit of row 3 waits for row 5; the short of row 4 for row 6; its exit of 6 for 8.
    expected = {3: ("ENTER_LONG", 0), 5: ("EXIT_STOP", 3), 6: ("ENTER_SHORT", 4), 8: ("EXIT_TIME", 6), 12: ("ENTER_LONG", 11)}
    assert got == [expected.get(i, ("NONE", None)) for i in range(13)]  # the long of row 8 is called off by row 10
    assert signals.open_loop_fills(rows, suppress_last=True).filter("pos = 12").first()["execution_event"] == "NONE"


def test_rebalancing_compares_with_the_last_sizing(spark):
    beta = [1.0, 1.05, 1.2, 1.25, 1.25, 2.0, 2.0]
    rows = [("A", "B", i, 10.0, 5.0, b, i != 4, True, "FLAT" if i == 6 else "LONG_SPREAD", "ENTER_LONG" if i == 0 else "EXIT_STOP" if i == 6 else "NONE") for i, b in enumerate(beta)]
    rows = spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, price_y double, price_x double, hedge_ratio double, observed_y boolean, observed_x boolean, executed_state string, execution_event string")
    got = positions.rebalance(positions.position_schedule(rows, 100.0), 100.0, 0.1).orderBy("pos").collect()
    assert [r["rebalance"] for r in got] == [False, False, True, False, False, True, False]
    assert [round(r["units_y"], 6) for r in got] == [5.0, 5.0, *[round(10 / 2.2, 6)] * 3, round(10 / 3, 6), 0.0]
    assert [r["gross_exposure"] == pytest.approx(100) for r in got[:6]] == [True] * 6


def test_kalman_equals_matrices(spark):
    x = np.exp(np.cumsum(RNG.normal(0, 0.02, 50)) + 4)
    y = np.exp(0.2 + 1.15 * np.log(x) + RNG.normal(0, 0.01, 50))
    state, p = np.array([0.0, 1.0]), np.eye(2)
    got = hedge.kalman(pair_rows(spark, y, x)).orderBy("pos").collect()
    for k, r in enumerate(got):
        p = p + (1e-5 * np.eye(2) if k else 0)
        h = np.array([1.0, np.log(x[k])])
        variance = h @ p @ h + 1e-3
        gain = p @ h / variance
        error = np.log(y[k]) - h @ state
        state, p = state + gain * error, p - np.outer(gain, h @ p)
        assert (r["alpha"], r["beta"], r["innovation"], r["innovation_variance"]) == tuple(pytest.approx(v, rel=1e-6) for v in (*state, error, variance))


def test_accounting_identities_and_ledger(spark):
    rng = random.Random(3)
    rows = [("A", "B", i, 100 + 10 * math.sin(i / 3), 50 + rng.random(), 2.0, *(("LONG_SPREAD" if 3 <= i % 10 < 7 else "FLAT"),), ("ENTER_LONG" if i % 10 == 3 else "EXIT_STOP" if i % 10 == 7 else "NONE"), True, True) for i in range(38)]
    fills = spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, price_y double, price_x double, hedge_ratio double, executed_state string, execution_event string, observed_y boolean, observed_x boolean")
    schedule = positions.force_close(positions.position_schedule(fills, 12000.0))
    book = accounting.financed_schedule(schedule, 1e6, 5, 2, 1, 0.02, 0.03, 0.01)
    assert quality.accounting_violations(book, 1e6).count() == 0 and quality.falling_costs(book, "cumulative_transaction_cost").count() == 0
    trades = ledger.ledger(book)
    assert trades.count() == 4 and ledger.reconcile(trades, book).first()["status"] == "RECONCILED"
    entry = schedule.filter("pos = 3").first()
    assert abs(entry["notional_y"]) == pytest.approx(4000) and abs(entry["notional_x"]) == pytest.approx(8000) and entry["gross_exposure"] == pytest.approx(12000)


def test_unknown_prices_stay_unknown(spark):
    rows = [("A", "B", i, None if i == 3 else 10.0 + i, 5.0, 1.0, "LONG_SPREAD" if i < 5 else "FLAT", "ENTER_LONG" if i == 0 else "NONE", True, True) for i in range(7)]
    fills = spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, price_y double, price_x double, hedge_ratio double, executed_state string, execution_event string, observed_y boolean, observed_x boolean")
    book = {r["pos"]: r for r in accounting.gross_schedule(positions.position_schedule(fills, 100.0), 1e3).collect()}
    assert book[2]["gross_pnl"] is not None and book[3]["gross_pnl"] is None and book[4]["gross_pnl"] is None and book[5]["gross_pnl"] is not None
    assert book[2]["cumulative_gross_pnl"] is not None and all(book[i]["cumulative_gross_pnl"] is None for i in (3, 4, 5, 6)) and book[3]["gross_exposure"] is None


def test_drawdown_episodes(spark):
    r = [-0.1, 0.2, 0.0, -0.1, -0.1, 0.5, -0.2]
    rows = spark.createDataFrame([("A", "B", i, v) for i, v in enumerate(r)], "symbol_y string, symbol_x string, pos long, r double")
    got = [tuple(x)[2:6] + tuple(x)[7:] for x in metrics.drawdown_episodes(rows).collect()]
    assert sorted(got, key=lambda t: t[1]) == [(None, 0, 0, 1, 2, True), (2, 3, 4, 5, 3, True), (5, 6, 6, None, 1, False)]


def test_bootstrap_blocks(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)], "pos long, r double")
    paths = {}
    for r in inference.moving_block_bootstrap(rows, 7, 6, 3).collect():
        paths.setdefault(r["replicate"], {})[r["pos"]] = r["r"]
    assert len(paths) == 6 and all(sorted(p) == list(range(50)) for p in paths.values())
    assert all(p[i + 1] == p[i] + 1 for p in paths.values() for i in range(49) if (i + 1) % 7)
    again = inference.moving_block_bootstrap(rows.repartition(5), 7, 6, 3).collect()
    assert {(r["replicate"], r["pos"], r["r"]) for r in again} == {(k, i, v) for k, p in paths.items() for i, v in p.items()}


def test_grid_and_upsert(spark):
    table = grid.parameter_grid(spark, {"a": [1.0, 2.0], "b": [3]}, {"a": 1.0, "b": 3})
    assert table.count() == 2 and table.filter("is_baseline").count() == 1 and table.select("scenario_id").distinct().count() == 2
    with pytest.raises(ValueError):
        grid.parameter_grid(spark, {"a": list(range(300))}, {"a": 0})
    old, new = spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "k int, v string, t int"), spark.createDataFrame([(1, "z", 1), (2, "w", 4)], "k int, v string, t int")
    assert {r["k"]: r["v"] for r in sources.upsert(old, new, ["k"], "t").collect()} == {1: "z", 2: "y"}


def test_clean_panel(spark):
    rows = [("A", f"2024-01-{d:02d}", float(d)) for d in (1, 2, 3, 4, 8)] + [("B", f"2024-01-{d:02d}", 1.0) for d in range(1, 9)] + [("C", "2024-01-01", 1.0)]
    prices = spark.createDataFrame(rows, "symbol string, date string, price double").withColumn("date", F.to_date("date"))
    got = {(r["symbol"], r["date"].day): (r["price"], r["observed"]) for r in sources.clean(prices, 0.5, 2).collect()}
    assert {d for _, d in got} == {1, 2, 3, 4, 5, 6, 8} and got["A", 6] == (4.0, False) and got["A", 8] == (8.0, True) and all(s != "C" for s, _ in got)


def test_folds(spark):
    n = spark.createDataFrame([(20,)], "n long")
    assert [tuple(r) for r in panel.folds(n, 10, 4).collect()] == [(0, 0, 9, 10, 13), (1, 4, 13, 14, 17)]
    assert [tuple(r)[:2] for r in panel.folds(n, 10, 4, 2, True).collect()] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert panel.folds(spark.createDataFrame([(13,)], "n long"), 10, 4).count() == 0


def test_windows_are_screened_as_whole_panels_are(spark):
    rows = []
    for name, (phi, noise) in {"X1": (0.2, 0.02), "X2": (0.7, 0.02), "X3": (1.0, 0.05)}.items():
        x, s = np.cumsum(RNG.normal(0, 0.02, 160)) + 4, [0.0]
        for e in RNG.normal(0, noise, 159):
            s.append(phi * s[-1] + e)
        rows += [("A", name, i, float(np.exp(x[i] + s[i])), float(np.exp(x[i]))) for i in range(160)]
    rows += [("A", "X4", i, 1.0 + i, 2.0) for i in range(160)] + [("A", "X5", i, 1.0 + i, 2.0 + i) for i in range(20)]
    frame = spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, price_y double, price_x double")
    a, b = ({r["symbol_x"]: r.asDict() for r in f(frame).collect()} for f in (hedge.screen, hedge.screen_windows))
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c, v in row.items():
            assert b[k][c] == (pytest.approx(v, rel=1e-6) if isinstance(v, float) else v), (k, c)


def test_folds_must_touch(spark):
    schema = "fold_id long, trading_start_pos long, trading_end_pos long, status string"
    done = spark.createDataFrame([(0, 10, 0.5), (0, 11, None)], "fold_id long, pos long, net_return_after_carry double")
    good = spark.createDataFrame([(0, 10, 11, "COMPLETED"), (1, 12, 13, "NO_SELECTION"), (2, 14, 14, "INSUFFICIENT_DATA")], schema)
    rows = walkforward.calendar_returns(good, done)
    assert [r["r"] for r in rows.orderBy("pos").collect()] == [0.5, None, 0.0, 0.0, None] and walkforward.gaps(good).count() == 0
    counts = walkforward.coverage(rows).first()
    assert (counts["folds"], counts["completed"], counts["no_selection"], counts["insufficient"], counts["scheduled_rows"], counts["executed_rows"], counts["known_rows"]) == (3, 1, 1, 1, 5, 2, 3)
    assert walkforward.conditional_returns(rows).count() == 2
    bad = spark.createDataFrame([(0, 10, 11, "COMPLETED"), (1, 13, 14, "NO_SELECTION")], schema)
    assert walkforward.gaps(bad).count() == 1
    with pytest.raises(Exception, match="not contiguous"):
        walkforward.calendar_returns(bad, done).collect()


def test_bootstrap_figures_are_those_of_its_paths(spark):
    rows = spark.createDataFrame([(i, 0.01 * math.sin(i * i)) for i in range(60)], "pos long, r double")
    paths = {}
    for x in inference.moving_block_bootstrap(rows, 7, 12, 3).collect():
        paths.setdefault(x["replicate"], {})[x["pos"]] = x["r"]
    figures = {"total_return": [], "annualized_volatility": [], "maximum_drawdown": []}
    for p in paths.values():
        r = np.array([p[i] for i in range(60)])
        equity = np.cumprod(1 + r)
        figures["total_return"].append(equity[-1] - 1)
        figures["annualized_volatility"].append(r.std(ddof=1) * math.sqrt(252))
        figures["maximum_drawdown"].append(min(0, (equity / np.maximum.accumulate(np.maximum(equity, 1)) - 1).min()))
    got = {x["metric"]: x for x in inference.bootstrap_metrics(rows, 7, 12, 3).collect()}
    for name, values in figures.items():
        assert [got[name][c] for c in ("low", "median", "high")] == [pytest.approx(q) for q in np.quantile(values, [0.025, 0.5, 0.975])] and got[name]["kind"] == "PRIMARY"
    flat = spark.createDataFrame([(i, 0.0) for i in range(20)], "pos long, r double")
    assert {x["kind"] for x in inference.bootstrap_metrics(flat, 5, 10, 3).collect()} == {"DESIGN"}  # all paths are one


def test_unknown_returns_make_sharpe_inference_unavailable(spark):
    rows = spark.createDataFrame([(k, i, None if k == 1 and i == 3 else 0.0 if k == 2 else 0.01 * math.sin(i) + 0.05 * (k == 3)) for k in range(4) for i in range(40)], "scenario_id int, pos long, r double")
    got = {r["scenario_id"]: r for r in inference.probabilistic_sharpe(rows, 0.0, ("scenario_id",)).collect()}
    assert {k: r["availability"] for k, r in got.items()} == {0: "AVAILABLE", 1: "UNAVAILABLE", 2: "UNAVAILABLE", 3: "AVAILABLE"}
    assert 0 < got[3]["p"] < 1e-12 and got[0]["p"] == pytest.approx(1 - got[0]["psr"])


def test_figures_of_keys_without_variation(spark):
    flat = spark.createDataFrame([("A", "B", i, 0.0, 0.0, "x") for i in range(5)], "symbol_y string, symbol_x string, pos long, r double, b double, label string")
    assert metrics.benchmark_metrics(flat).first()["correlation"] is None and inference.regime_consistency(flat, ("symbol_y", "symbol_x")).first()["share"] is None
    trades = spark.createDataFrame([("A", "B", 1, None, 3)], "symbol_y string, symbol_x string, trade_id long, net_pnl double, holding_period_rows long")
    assert metrics.trade_metrics(trades).first()["win_rate"] is None


def test_undecided_fills(spark):
    rows = [("A", "B", 0, "ENTER_LONG", "NONE", "FLAT"), ("A", "B", 1, "NONE", "ENTER_LONG", "LONG_SPREAD"), ("A", "B", 2, "NONE", "EXIT_STOP", "FLAT"), ("A", "B", 3, "ENTER_LONG", "ENTER_LONG", "LONG_SPREAD")]
    rows = spark.createDataFrame(rows, "symbol_y string, symbol_x string, pos long, event string, execution_event string, executed_state string").withColumn("observed_y", F.lit(True)).withColumn("observed_x", F.lit(True))
    assert sorted((r["pos"], r["rule"]) for r in quality.execution_violations(rows).collect()) == [(2, "undecided"), (3, "undecided")]


REPORTS = {
    "G01": "SELECT symbol_y, symbol_x, rank FROM stored WHERE run_id = 'run-b' AND selected",
    "G02": "SELECT group_name, count(*) AS pairs, count(*) FILTER (selected) AS selected, count(*) FILTER (selected) / count(*) AS selection_rate FROM stored GROUP BY 1",
    "G03": "SELECT symbol_y, symbol_x, count(DISTINCT run_id) AS runs FROM stored WHERE selected GROUP BY 1, 2",
    "G04": "SELECT symbol_y, symbol_x, avg(corrected_p) AS mean_p, avg(half_life) AS mean_half_life, avg(hurst) AS mean_hurst, count(*) AS n FROM stored WHERE selected GROUP BY 1, 2",
    "G05": "SELECT reason, count(*) AS pairs FROM (SELECT unnest(rejection_reasons) AS reason FROM stored) GROUP BY 1",
    "G06": "SELECT run_id, count(*) AS pairs, count(*) FILTER (selected) AS selected, avg(corrected_p) FILTER (selected) AS mean_p, median(half_life) FILTER (selected) AS median_half_life, max(rank) AS worst_rank FROM stored GROUP BY 1",
    "H15": "SELECT run_id, symbol_y, symbol_x FROM stored WHERE rank = 1",
}


def test_reports_over_stored_screening_results(spark):
    """The stored p is the cointegration test's; reports over stored rows equal their SQL."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    stored = durable.written(catalog_research.s07_full(spark, folder))
    con = duckdb.connect()
    con.register("arrow", stored.toArrow())
    con.execute("CREATE TABLE stored AS SELECT * FROM arrow")
    got = {
        "G01": store.load_screening(stored, "run-b", True), "G02": store.selection_by_group(stored), "G03": store.most_selected(stored), "G04": store.mean_diagnostics(stored),
        "G05": store.rejection_counts(stored.withColumn("rejection_reasons", F.to_json("rejection_reasons"))), "G06": store.run_summary(stored), "H15": stored.filter("rank = 1"),
    }
    for name, sql in REPORTS.items():
        expected = con.sql(sql)
        rows, other = sorted(map(tuple, got[name].select(*expected.columns).collect()), key=str), sorted(expected.fetchall(), key=str)
        assert len(rows) == len(other) and all(a == (pytest.approx(b) if isinstance(b, float) else b) for x, y in zip(rows, other) for a, b in zip(x, y)), name
    half = catalog_core.brand_panel(spark, folder).filter("date < '1998-06-01'")
    able = half.groupBy("symbol_y", "symbol_x").count().filter("count >= 50")
    test = {(r["symbol_y"], r["symbol_x"]): r["p_value"] for r in hedge.cointegration(half.join(able, ["symbol_y", "symbol_x"], "left_semi")).collect()}
    kept = {(r["symbol_y"], r["symbol_x"]): r["p_value"] for r in stored.filter("run_id = 'run-a' and corrected_p is not null").collect()}
    assert kept and kept.keys() == test.keys() and all(kept[k] == pytest.approx(v, rel=1e-5, abs=1e-9) for k, v in test.items())

"""Registered queries: walk-forward, grids, inference, portfolios, risk, reports and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantmill.functions.durable import shared_folder, written
from quantmill.operators import grid, inference, panel, portfolio, quality, risk, signals, walkforward
from quantmill.plans import jobs, panels
from quantmill.plans.catalog_core import FOLDS, NUMBERED, brand_folds, numbered, s07
from quantmill.plans.panels import CAPITAL, PAIR, SHARED, accounts, brand_prices, returns, shared  # noqa: F401
from quantmill.registry import register
from quantmill.sources import store

KEYS = "symbol_y symbol_x"
BASE = {"entry_z": 2.0, "exit_z": 0.5, "stop_z": 3.5, "zscore_lookback": 60, "formation_window": 504, "trading_window": 63}
AXES = ("entry_z", "exit_z", "formation_window", "zscore_lookback")
RULES = signals.Rules(1.0, 0.25, 3.5, 20, 1)


# --- walk-forward ----------------------------------------------------------------------------------------------------
@register("K01_folds", "fold_id:i formation_start_pos:i formation_end_pos:i trading_start_pos:i trading_end_pos:i", FOLDS)
def k01(spark, sf):
    return brand_folds(spark, sf)


@register("K01_expanding_folds", "fold_id:i formation_start_pos:i formation_end_pos:i trading_start_pos:i", f"SELECT fold_id, 0 AS formation_start_pos, formation_end_pos, trading_start_pos FROM ({FOLDS})")
def k01b(spark, sf):
    return panel.folds(brand_prices(spark, sf).agg(F.count_distinct("date").alias("n")), 504, 63, expanding=True)


@register("K02_group_rules", "symbol n:i", "SELECT symbol, count(*) AS n FROM (SELECT symbol FROM uni UNION ALL SELECT symbol FROM uni WHERE group_name = 'G3') GROUP BY 1 HAVING count(*) > 1")
def k02(spark, sf):
    groups = panels.universe(brand_prices(spark, sf))
    return quality.repeated_keys(groups.union(groups.filter("group_name = 'G3'")), ["symbol"])


def marks(spark, sf):
    """The cleaned market: every date has a mark of every symbol."""
    return shared("marks", lambda spark, sf: written(panels.marked_prices(spark, sf)), spark, sf)


def fold_panel(spark, sf):
    """Pairs of the cleaned market: marks of both legs, which of them are observed, and the date's position."""
    rows = marks(spark, sf)
    return panel.pair_panel(panel.candidate_pairs(panels.market_universe(rows)), rows.drop("pos")).drop("pos").join(rows.select("date", "pos").distinct(), "date")


def mark_folds(spark, sf):
    return panel.folds(marks(spark, sf).agg(F.count_distinct("date").alias("n")), 504, 63)


def _walk(spark, sf):
    """Folds, screening, traded rows and calendar of one walk-forward."""
    folds, rows = mark_folds(spark, sf), written(fold_panel(spark, sf))
    screened, done = walkforward.run_folds(rows, folds, RULES, 20, target=panels.NOTIONAL, capital=CAPITAL, costs=panels.COSTS)
    return folds, screened, done, written(walkforward.calendar_returns(walkforward.fold_status(folds, screened.filter("corrected_p is not null"), done), done))


def walk(spark, sf):
    return shared("walk", _walk, spark, sf)


@register("K03_fold_trading", f"fold_id:i {KEYS} pos:i executed_state execution_event net_pnl_after_carry:4 net_return_after_carry:9")
def k03(spark, sf):
    return walk(spark, sf)[2]


@register("K03_fold_screening", f"fold_id:i {KEYS} observations:i beta:6 p_value:6 corrected_p:6 selected rank:i")
def k03b(spark, sf):
    return walk(spark, sf)[1]


@register("K04_trading_rows", "fold_id:i symbol observed:i", f"SELECT fold_id, symbol, count(*) AS observed FROM ({NUMBERED}) JOIN ({FOLDS}) ON pos BETWEEN trading_start_pos AND trading_end_pos GROUP BY 1, 2")
def k04(spark, sf):
    return panel.in_fold(numbered(spark, sf), brand_folds(spark, sf), "trading").groupBy("fold_id", "symbol").agg(F.count("*").alias("observed"))


def calendar(spark, sf):
    return walk(spark, sf)[3]


@register("K05_coverage", "folds:i completed:i no_selection:i insufficient:i scheduled_rows:i executed_rows:i known_rows:i coverage:6")
def k05(spark, sf):
    return walkforward.coverage(calendar(spark, sf))


@register("K05_conditional_returns", "fold_id:i pos:i r:9")
def k05b(spark, sf):
    return walkforward.conditional_returns(calendar(spark, sf))


REPORT = "availability reason complete total_return:9 annualized_volatility:9 maximum_drawdown:9"


@register("K06_return_report", f"fold_id:i {REPORT}")
def k06(spark, sf):
    return walkforward.return_report(calendar(spark, sf), ("fold_id",))


@register("K06_aggregate_report", f"kind {REPORT}")
def k06b(spark, sf):
    """Reports over all folds: of all scheduled rows, and of executed folds only."""
    rows = calendar(spark, sf)
    both = rows.withColumn("kind", F.lit("calendar")).union(walkforward.conditional_returns(rows).withColumn("kind", F.lit("conditional")))
    return walkforward.return_report(both, ("kind",))


# --- grid ------------------------------------------------------------------------------------------------------------
#: Axes out of the region keys 0 to 4: entries 1.0 to 3.0, exits 0.25 to 0.75, formation windows and look-backs.
GRID = """SELECT *, 'scenario-' || substr(sha256(concat_ws('|', e, x, '3.5', z, f, '63')), 1, 12) AS scenario_id, CAST(e AS DOUBLE) AS entry_z, CAST(x AS DOUBLE) AS exit_z, CAST(z AS INT) AS zscore_lookback, CAST(f AS INT) AS formation_window, e = '2.0' AND x = '0.5' AND z = '60' AND f = '504' AS is_baseline
  FROM (SELECT CAST(CAST(1 + r_regionkey * 0.5 AS DOUBLE) AS VARCHAR) AS e FROM region) a, (SELECT CAST(CAST(r_regionkey / 4.0 AS DOUBLE) AS VARCHAR) AS x FROM region WHERE r_regionkey BETWEEN 1 AND 3) b,
    (SELECT CAST(252 * r_regionkey AS VARCHAR) AS f FROM region WHERE r_regionkey BETWEEN 1 AND 2) c, (SELECT CAST(CAST(CASE r_regionkey WHEN 0 THEN 30 WHEN 1 THEN 60 ELSE 300 END AS INT) AS VARCHAR) AS z FROM region WHERE r_regionkey < 3) d"""


def scenarios(spark, sf):
    keys = sorted(r[0] for r in panels.table(spark, sf, "region").select("r_regionkey").collect())  # five regions
    axes = {"entry_z": [1 + k * 0.5 for k in keys], "exit_z": [k / 4 for k in keys if 1 <= k <= 3], "formation_window": [252 * k for k in keys if 1 <= k <= 2], "zscore_lookback": [{0: 30, 1: 60}.get(k, 300) for k in keys if k < 3]}
    return grid.parameter_grid(spark, axes, BASE)


@register("R01_parameter_grid", "scenario_id entry_z:6 exit_z:6 zscore_lookback:i formation_window:i is_baseline", GRID)
def r01(spark, sf):
    return scenarios(spark, sf)


ERRORS = f"SELECT *, CASE WHEN entry_z <= exit_z THEN 'entry_z must be above exit_z' WHEN zscore_lookback > formation_window THEN 'zscore_lookback must fit into formation' END AS error FROM ({GRID})"


@register("R02_configuration_errors", "scenario_id error", ERRORS)
def r02(spark, sf):
    return grid.configuration_errors(scenarios(spark, sf))


@register("R03_universe_by_fold", "fold_id:i group_name symbols:i", f"SELECT fold_id, group_name, count(*) AS symbols FROM (SELECT fold_id, symbol FROM ({NUMBERED}) JOIN ({FOLDS}) ON pos BETWEEN formation_start_pos AND formation_end_pos GROUP BY 1, 2 HAVING count(*) >= 300) JOIN uni USING (symbol) GROUP BY 1, 2 HAVING count(*) >= 2")
def r03(spark, sf):
    eligible = walkforward.formation_eligible(numbered(spark, sf), brand_folds(spark, sf), 300)
    return walkforward.possible_groups(eligible, panels.universe(brand_prices(spark, sf)))


SCENARIO_FOLDS = f"SELECT scenario_id, k AS fold_id, k * 63 + formation_window AS trading_start_pos, k * 63 + formation_window + 62 AS trading_end_pos FROM ({GRID}) g, range(0, 40) t(k) WHERE k * 63 + formation_window + 63 <= (SELECT count(DISTINCT date) FROM px)"


def scenario_folds(spark, sf):
    dates = brand_prices(spark, sf).select("date").distinct().count()
    return grid.scenario_folds(scenarios(spark, sf), dates)


@register("R04_scenario_folds", "scenario_id fold_id:i trading_start_pos:i trading_end_pos:i", SCENARIO_FOLDS)
def r04(spark, sf):
    return scenario_folds(spark, sf)


@register("R05_scenario_reports", f"{KEYS} availability total_return:9", "SELECT symbol_y, symbol_x, 'AVAILABLE' AS availability, exp(sum(ln(1 + r))) - 1 AS total_return FROM rt GROUP BY 1, 2")
def r05(spark, sf):
    return walkforward.return_report(returns(spark, sf), PAIR)


@register("R06_common_horizon", "pos:i", f"SELECT p AS pos FROM (SELECT DISTINCT scenario_id, p FROM ({SCENARIO_FOLDS}) s, range(0, 2500) t(p) WHERE p BETWEEN trading_start_pos AND trading_end_pos) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM ({GRID}))")
def r06(spark, sf):
    rows = scenario_folds(spark, sf).select("scenario_id", F.explode(F.sequence("trading_start_pos", "trading_end_pos")).alias("pos"))
    return panel.common_labels(rows, "scenario_id", "pos")


LONG = "SELECT 'total_return' AS metric, exp(sum(ln(1 + r))) - 1 AS value FROM rt GROUP BY symbol_y, symbol_x UNION ALL SELECT 'volatility', stddev_samp(r) FROM rt GROUP BY symbol_y, symbol_x"


def long_metrics(spark, sf):
    rows = returns(spark, sf).groupBy(*PAIR).agg(F.expm1(F.sum(F.log1p("r"))).alias("total_return"), F.stddev_samp("r").alias("volatility"))
    return rows.unpivot(list(PAIR), ["total_return", "volatility"], "metric", "value")


@register("R07_distributions", "metric n:i lowest:9 q1:9 median:9 q3:9 highest:9 mean:9", f"SELECT metric, count(*) AS n, min(value) AS lowest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS highest, avg(value) AS mean FROM ({LONG}) GROUP BY 1")
def r07(spark, sf):
    return grid.distribution(long_metrics(spark, sf), "metric")


@register("R08_positive_fractions", "metric eligible:i defined:i of_defined:9 of_eligible:9", f"SELECT metric, count(*) AS eligible, count(value) AS defined, count(*) FILTER (value > 0) / count(value) AS of_defined, count(*) FILTER (value > 0) / count(*) AS of_eligible FROM ({LONG}) GROUP BY 1")
def r08(spark, sf):
    return grid.positive_fractions(long_metrics(spark, sf), "metric")


@register("R09_axis_metadata", "parameter value:6 step:6", f"SELECT parameter, value, lead(value) OVER (PARTITION BY parameter ORDER BY value) - value AS step FROM (SELECT DISTINCT 'entry_z' AS parameter, entry_z AS value FROM ({GRID}) UNION ALL SELECT DISTINCT 'exit_z', exit_z FROM ({GRID}) UNION ALL SELECT DISTINCT 'zscore_lookback', zscore_lookback FROM ({GRID}) UNION ALL SELECT DISTINCT 'formation_window', formation_window FROM ({GRID}))")
def r09(spark, sf):
    return grid.axis_metadata(scenarios(spark, sf), list(AXES))


_LONG_AXES = " UNION ALL ".join(f"SELECT scenario_id, '{a}' AS parameter, CAST({a} AS DOUBLE) AS value FROM ({GRID})" for a in AXES)
VARIANTS = f"""SELECT scenario_id, parameter, value, base, abs(place - base_place) AS places, abs(place - base_place) = 1 AS adjacent FROM (SELECT *, max(CASE WHEN value = base THEN place END) OVER (PARTITION BY parameter) AS base_place, count(*) FILTER (value <> base) OVER (PARTITION BY scenario_id) AS changed
  FROM (SELECT l.*, b.value AS base, dense_rank() OVER (PARTITION BY l.parameter ORDER BY l.value) AS place FROM ({_LONG_AXES}) l JOIN ({_LONG_AXES}) b ON b.parameter = l.parameter AND b.scenario_id = (SELECT scenario_id FROM ({GRID}) WHERE is_baseline))) WHERE changed = 1 AND value <> base"""


@register("R10_one_parameter_variants", "scenario_id parameter value:6 base:6 places:i adjacent", VARIANTS)
def r10(spark, sf):
    return grid.one_parameter_variants(scenarios(spark, sf), list(AXES))


SENSITIVITY = """SELECT count(*) AS scenarios, count(*) AS completed, count(total_return) AS defined, count(*) - 1 AS variants, true AS headline, min(total_return) AS worst, max(total_return) AS best, count(*) FILTER (total_return > 0) / count(*) AS positive_share,
  count(*) FILTER (dd >= -0.001) / count(*) AS mild_drawdown_share, max(base) AS baseline_total_return, count(*) FILTER (sign(total_return) = sign(base) AND NOT is_baseline) / (count(*) - 1) AS variant_sign_agreement
  FROM (SELECT *, symbol_y = 'Brand#1' AND symbol_x = 'Brand#11' AS is_baseline, max(CASE WHEN symbol_y = 'Brand#1' AND symbol_x = 'Brand#11' THEN total_return END) OVER () AS base FROM (SELECT symbol_y, symbol_x, exp(sum(ln(1 + r))) - 1 AS total_return FROM rt GROUP BY 1, 2))
    JOIN (SELECT symbol_y, symbol_x, min(drawdown) AS dd FROM eq GROUP BY 1, 2) USING (symbol_y, symbol_x)"""


@register("R11_sensitivity_summary", "scenarios:i completed:i defined:i variants:i headline worst:9 best:9 positive_share:9 mild_drawdown_share:9 baseline_total_return:9 variant_sign_agreement:9", SENSITIVITY)
def r11(spark, sf):
    """The same over pairs instead of scenarios, which SQL can run."""
    name = F.concat_ws("|", *PAIR).alias("scenario_id")
    common = r05(spark, sf).select(name, "total_return", "sharpe_ratio", "maximum_drawdown")
    pairs = common.select("scenario_id", F.lit("COMPLETED").alias("status"), (F.col("scenario_id") == "Brand#1|Brand#11").alias("is_baseline"))
    return grid.sensitivity_summary(pairs, common, pairs.filter("not is_baseline"), -0.001)


def _grid(spark, sf):
    """Scenario table, calendar and trades of the walk-forwards of all scenarios."""
    every = written(grid.configuration_errors(scenarios(spark, sf)))
    valid = every.filter("error is null")
    lookbacks = sorted(r[0] for r in valid.select("zscore_lookback").distinct().collect())  # an axis of the grid
    folds = grid.scenario_folds(valid, marks(spark, sf).select("date").distinct().count())
    rows, done = walkforward.run_grid(written(fold_panel(spark, sf)), valid, folds, lookbacks, target=panels.NOTIONAL, capital=CAPITAL, costs=panels.COSTS)
    return every, rows, done


def grid_run(spark, sf):
    return shared("grid", _grid, spark, sf)


def scenario_reports(spark, sf):
    return walkforward.scenario_reports(*grid_run(spark, sf))


FIGURES = ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "maximum_drawdown")


def common_calendar(spark, sf):
    """Returns of all comparable scenarios over the rows that all of them have scheduled."""
    return shared("common", lambda spark, sf: written(grid.common_horizon(grid_run(spark, sf)[1], scenario_reports(spark, sf))), spark, sf)


def common_reports(spark, sf):
    """Reports on the common horizon; figures only where no return of it is unknown."""
    report = walkforward.return_report(common_calendar(spark, sf), ("scenario_id",))
    able = (F.col("availability") == "AVAILABLE") & F.col("complete")
    return report.withColumns({c: F.when(able, F.col(c)) for c in FIGURES}).join(scenarios(spark, sf).select("scenario_id", "is_baseline"), "scenario_id")


@register("R04_scenario_runs", "scenario_id status error folds:i completed:i scheduled_rows:i known_rows:i trades:i known_costs:i unknown_costs:i")
def r04b(spark, sf):
    return scenario_reports(spark, sf)


@register("R05_scenario_outcomes", "scenario_id status availability reason total_return:9 maximum_drawdown:9")
def r05b(spark, sf):
    return scenario_reports(spark, sf)


@register("R06_common_reports", f"scenario_id {REPORT}")
def r06b(spark, sf):
    return common_reports(spark, sf)


@register("R06_common_rows", "pos:i scenarios:i known:i")
def r06c(spark, sf):
    """The common horizon itself: how many scenarios have a known return in each of its rows."""
    return common_calendar(spark, sf).groupBy("pos").agg(F.count_distinct("scenario_id").alias("scenarios"), F.count("r").alias("known"))


@register("R07_scenario_distributions", "metric n:i lowest:9 q1:9 median:9 q3:9 highest:9 mean:9")
def r07b(spark, sf):
    return grid.distribution(common_reports(spark, sf).unpivot(["scenario_id"], list(FIGURES), "metric", "value"), "metric")


SUMMARY = "scenarios:i completed:i unavailable:i invalid:i failed:i eligible:i defined:i variants:i headline baseline_total_return:9 worst:9 best:9 positive_share:6 positive_sharpe_share:6 mild_drawdown_share:6 variant_sign_agreement:6 variant_positive_sharpe_share:6"


@register("R11_grid_sensitivity", SUMMARY)
def r11b(spark, sf):
    return grid.sensitivity_summary(scenario_reports(spark, sf), common_reports(spark, sf), grid.one_parameter_variants(scenarios(spark, sf), list(AXES)), -0.02)


@register("R12_grid_run", "scenario_id entry_z:6 exit_z:6 zscore_lookback:i formation_window:i is_baseline status folds:i trades:i total_return:9 sharpe_ratio:6 maximum_drawdown:9")
def r12(spark, sf):
    """Every scenario's walk-forward, all in one plan: the scenario is a key."""
    return scenario_reports(spark, sf)


@register("R13_grid_table", "scenario_id entry_z:6 exit_z:6 status reason total_return:9 common_total_return:9 common_maximum_drawdown:9 baseline_difference:9")
def r13b(spark, sf):
    """A flat table of all scenarios, ordered by id, with figures of their own calendar and of the common horizon."""
    common = common_reports(spark, sf)
    base = common.filter("is_baseline").select(F.col("total_return").alias("base"))
    common = common.select("scenario_id", F.col("total_return").alias("common_total_return"), F.col("maximum_drawdown").alias("common_maximum_drawdown"))
    out = scenario_reports(spark, sf).withColumn("reason", F.coalesce("error", "reason")).join(common, "scenario_id", "left").join(base, how="left")  # one row
    return out.withColumn("baseline_difference", F.col("common_total_return") - F.col("base")).orderBy("scenario_id")


@register("R14_group_snapshots", "formation_window:i fold_id:i group_name symbols")
def r14c(spark, sf):
    """The universe that each fold of the grid could choose from: symbols with enough usable marks in formation, by group."""
    every, _, _ = grid_run(spark, sf)
    rows = marks(spark, sf)
    folds = grid.scenario_folds(every.filter("error is null"), rows.select("date").distinct().count()).join(every.select("scenario_id", "formation_window"), "scenario_id").drop("scenario_id").distinct()
    return walkforward.group_snapshots(rows, folds, panels.market_universe(rows), ("formation_window", "fold_id"), 100)


@register("R14_run_provenance", "scenarios:i invalid:i formation_windows lookbacks first_pos:i last_pos:i pairs:i")
def r14b(spark, sf):
    """What a grid run was made of."""
    every, rows, done = grid_run(spark, sf)
    out = every.agg(F.count("*").alias("scenarios"), F.count("error").alias("invalid"), F.concat_ws(",", F.sort_array(F.collect_set("formation_window"))).alias("formation_windows"), F.concat_ws(",", F.sort_array(F.collect_set("zscore_lookback"))).alias("lookbacks"))
    return out.join(rows.agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")), how="left").join(done.agg(F.count_distinct(*PAIR).alias("pairs")), how="left")  # one row each


@register("R13_sensitivity_table", "scenario_id entry_z:6 error", f"SELECT * FROM ({ERRORS}) ORDER BY scenario_id")
def r13(spark, sf):
    return r02(spark, sf).orderBy("scenario_id")


@register("R14_provenance", "groups pairs:i", "SELECT array_to_string(list_sort(list_distinct(list(group_name))), ',') AS groups, count(*) AS pairs FROM pairs")
def r14(spark, sf):
    return panels.brand_pairs(spark, sf).agg(F.array_join(F.sort_array(F.collect_set("group_name")), ",").alias("groups"), F.count("*").alias("pairs"))


# --- inference -------------------------------------------------------------------------------------------------------
@register("V01_block_bootstrap", f"{KEYS} replicate:i pos:i r:9")
def v01(spark, sf):
    return inference.moving_block_bootstrap(returns(spark, sf), 20, 4, 7, PAIR)


@register("V02_bootstrap_metrics", f"{KEYS} metric replicates:i defined:i low:9 median:9 high:9 kind")
def v02(spark, sf):
    return inference.bootstrap_metrics(returns(spark, sf), 20, 1000, 7, PAIR)


MOMENTS = """SELECT symbol_y, symbol_x, n, CASE WHEN able THEN m / s END AS sharpe, CASE WHEN able THEN g1 * sqrt(n * (n - 1)) / (n - 2) END AS skew, CASE WHEN able THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3 END AS kurtosis
  FROM (SELECT symbol_y, symbol_x, CAST(count(*) AS DOUBLE) AS n, any_value(m) AS m, any_value(s) AS s, count(*) >= 4 AND any_value(s) > 1e-12 * greatest(1.0, max(abs(r))) AS able, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS g1, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) - 3 AS g2
    FROM rt JOIN (SELECT symbol_y, symbol_x, avg(r) AS m, stddev_samp(r) AS s FROM rt GROUP BY 1, 2) USING (symbol_y, symbol_x) GROUP BY 1, 2)"""
VARIANCE = f"SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS variance FROM ({MOMENTS})"


@register("V03_probabilistic_sharpe", f"{KEYS} n:i sharpe:7 skew:5 kurtosis:4 z:5", f"SELECT *, CASE WHEN variance > 0 THEN sharpe * sqrt(n - 1) / sqrt(variance) END AS z FROM ({VARIANCE})")
def v03(spark, sf):
    return inference.probabilistic_sharpe(returns(spark, sf), 0.0, PAIR)


@register("V03_sharpe_probability", f"{KEYS} psr:6 p:6")
def v03b(spark, sf):
    return inference.probabilistic_sharpe(returns(spark, sf), 0.0, PAIR)


@register("V04_minimum_track_record", f"{KEYS} minimum_track_record:i", f"SELECT symbol_y, symbol_x, CASE WHEN sharpe > 0 AND variance > 0 THEN greatest(4, ceil(1 + variance * pow(1.6448536269514715 / sharpe, 2))) END AS minimum_track_record FROM ({VARIANCE})")
def v04(spark, sf):
    return inference.minimum_track_record(returns(spark, sf), 0.0, 0.95, PAIR)


def yearly(spark, sf):
    return returns(spark, sf).withColumn("fold_id", F.year("date").cast("long"))


YEARLY = "SELECT symbol_y, symbol_x, CAST(year(date) AS BIGINT) AS fold_id, exp(sum(ln(1 + r))) - 1 AS total_return, count(r) AS known, min(r) <= -1 AS catastrophic FROM rt GROUP BY 1, 2, 3"


@register("V05_fold_metrics", f"{KEYS} fold_id:i known:i catastrophic total_return:9", YEARLY)
def v05(spark, sf):
    return inference.fold_metrics(yearly(spark, sf), (*PAIR, "fold_id"))


@register("V06_fold_consistency", f"{KEYS} folds:i positive:i negative:i q1:9 median:9 q3:9 best:9 worst:9 top_share:6 top_fifth_share:6", f"""SELECT symbol_y, symbol_x, count(*) AS folds, count(*) FILTER (total_return > 0) AS positive, count(*) FILTER (total_return < 0) AS negative, quantile_cont(total_return, 0.25) AS q1, quantile_cont(total_return, 0.5) AS median, quantile_cont(total_return, 0.75) AS q3,
  max(total_return) AS best, min(total_return) AS worst, max(total_return) FILTER (total_return > 0) / sum(total_return) FILTER (total_return > 0) AS top_share, sum(total_return) FILTER (total_return > 0 AND k <= ceil(up * 0.2)) / sum(total_return) FILTER (total_return > 0) AS top_fifth_share
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol_y, symbol_x ORDER BY total_return DESC, fold_id) AS k, count(*) FILTER (total_return > 0) OVER (PARTITION BY symbol_y, symbol_x) AS up FROM ({YEARLY})) GROUP BY 1, 2""")
def v06(spark, sf):
    return inference.fold_consistency(v05(spark, sf), PAIR)


@register("V07_regime_consistency", f"{KEYS} label total_return:9 contribution:9 share:6 worst", """SELECT *, contribution / nullif(sum(abs(contribution)) OVER (PARTITION BY symbol_y, symbol_x), 0) AS share, row_number() OVER (PARTITION BY symbol_y, symbol_x ORDER BY total_return, first_pos) = 1 AS worst
  FROM (SELECT symbol_y, symbol_x, CAST(year(date) AS VARCHAR) AS label, exp(sum(ln(1 + r))) - 1 AS total_return, sum(r) AS contribution, min(pos) AS first_pos FROM rt GROUP BY 1, 2, 3)""")
def v07(spark, sf):
    return inference.regime_consistency(yearly(spark, sf).withColumn("label", F.col("fold_id").cast("string")), PAIR)


@register("V08_multiplicity", "p_partkey:i bonferroni_p:12 bh_p:12 bh_discovery", """SELECT *, least(1.0, p * m) AS bonferroni_p, greatest(0.0, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS bh_p, greatest(0.0, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) <= 0.05 AS bh_discovery
  FROM (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, 5000.0::DOUBLE AS m FROM (SELECT p_partkey, p_partkey / 1e7 AS p FROM part))""")
def v08(spark, sf):
    tests = panels.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") / 1e7).alias("p"))
    return inference.multiplicity(tests, 5000, 0.05, (), ("p_partkey",))


def scenario_sharpes(spark, sf):
    """The probabilistic Sharpe ratio of every scenario that could run, on the common horizon."""
    return scenario_reports(spark, sf).select("scenario_id", "status").join(inference.probabilistic_sharpe(common_calendar(spark, sf), 0.0, ("scenario_id",)), "scenario_id", "left")


@register("V08_scenario_multiplicity", "scenario_id family:i p:9 bonferroni_p:9 bh_p:9 bonferroni_discovery bh_discovery")
def v08b(spark, sf):
    """The family is every scenario that is neither invalid nor failed, whether its p is known or not."""
    return inference.multiplicity(scenario_sharpes(spark, sf).filter(~F.col("status").isin(*grid.UNFIT)), None, 0.05)


@register("V08_multiplicity_counts", "configurations:i invalid:i failed:i eligible:i known_p:i unavailable:i raw_exceedances:i bonferroni_exceedances:i bh_discoveries:i")
def v08c(spark, sf):
    own = v08b(spark, sf).select("scenario_id", "bonferroni_p", "bh_p")
    return inference.multiplicity_counts(scenario_sharpes(spark, sf).join(own, "scenario_id", "left"))


@register("V09_scenario_report", "scenario_id sharpe_availability calendar_availability fold_availability availability")
def v09b(spark, sf):
    """Availability of a scenario's report: the worst of its Sharpe inference, its calendar and its folds (two known or more)."""
    _, rows, _ = grid_run(spark, sf)
    folds = inference.fold_metrics(rows, ("scenario_id", "fold_id")).groupBy("scenario_id").agg(F.when(F.count("total_return") < 2, "INSUFFICIENT").otherwise("AVAILABLE").alias("fold_availability"))
    calendar_part = walkforward.return_report(rows, ("scenario_id",)).select("scenario_id", F.when(F.col("availability") != "AVAILABLE", "UNAVAILABLE").when(~F.col("complete"), "INSUFFICIENT").otherwise("AVAILABLE").alias("calendar_availability"))
    parts = scenario_sharpes(spark, sf).select("scenario_id", F.coalesce("availability", F.lit("UNAVAILABLE")).alias("sharpe_availability")).join(calendar_part, "scenario_id", "left").join(folds, "scenario_id", "left")
    parts = parts.na.fill("UNAVAILABLE")
    long = parts.unpivot(["scenario_id"], ["sharpe_availability", "calendar_availability", "fold_availability"], "part", "availability")
    return parts.join(inference.roll_up(long, ("scenario_id",)), "scenario_id")


@register("V09_report_roll_up", f"{KEYS} availability", "SELECT symbol_y, symbol_x, CASE WHEN count(*) FILTER (n < 50) > 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (n < 130) > 0 THEN 'INSUFFICIENT' ELSE 'AVAILABLE' END AS availability FROM (SELECT symbol_y, symbol_x, year(date) AS y, count(*) AS n FROM rt GROUP BY 1, 2, 3) GROUP BY 1, 2")
def v09(spark, sf):
    parts = yearly(spark, sf).groupBy(*PAIR, "fold_id").agg(F.count("*").alias("n"))
    return inference.roll_up(parts.withColumn("availability", F.when(F.col("n") < 50, "UNAVAILABLE").when(F.col("n") < 130, "INSUFFICIENT").otherwise("AVAILABLE")), PAIR)


# --- portfolio and risk ----------------------------------------------------------------------------------------------
DAYS = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS at FROM (SELECT DISTINCT date FROM pp)"
ALIGNED = f"""SELECT p.pair_id, d.at AS pos, CASE WHEN p.pair_id = 'Brand#1|Brand#11' AND d.at = 2000 THEN NULL WHEN p.pair_id = 'Brand#2|Brand#7' AND d.at >= 1000 THEN CASE WHEN d.at = 1000 THEN -1.0 ELSE 0.01 END ELSE coalesce(r.r, 0.0) END AS r
  FROM (SELECT symbol_y || '|' || symbol_x AS pair_id, symbol_y, symbol_x FROM pairs) p CROSS JOIN ({DAYS}) d LEFT JOIN rt r ON r.symbol_y = p.symbol_y AND r.symbol_x = p.symbol_x AND r.date = d.date"""
ALLOCATED = f"SELECT pair_id, 0.9 / count(*) OVER () AS weight, 0.9 / count(*) OVER () * {CAPITAL} AS allocated_capital FROM (SELECT symbol_y || '|' || symbol_x AS pair_id FROM pairs)"


def days(spark, sf):
    dates = accounts(spark, sf).select("date").distinct()  # those that two symbols of a group have
    return dates.withColumn("at", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def aligned(spark, sf):
    """Returns of all pairs on a common calendar; one pair has an unknown return, one loses everything."""
    pairs = portfolio.pair_inputs(panels.brand_pairs(spark, sf))
    spine = pairs.select(*PAIR, "pair_id").crossJoin(F.broadcast(days(spark, sf)))
    rows = spine.join(returns(spark, sf).select(*PAIR, "date", "r"), [*PAIR, "date"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    unknown, ruined = (F.col("pair_id") == "Brand#1|Brand#11") & (F.col("at") == 2000), (F.col("pair_id") == "Brand#2|Brand#7") & (F.col("at") >= 1000)
    return rows.select("pair_id", F.col("at").alias("pos"), F.when(unknown, None).when(ruined, F.when(F.col("at") == 1000, -1.0).otherwise(0.01)).otherwise(F.col("r")).alias("r"))


def allocations(spark, sf):
    pairs = portfolio.pair_inputs(panels.brand_pairs(spark, sf)).select("pair_id")
    pairs = pairs.withColumn("w", 0.9 / F.count("*").over(Window.partitionBy(F.lit(1))))
    return portfolio.allocate(pairs, CAPITAL, "w").select("pair_id", "weight", "allocated_capital")


@register("M01_pair_inputs", "pair_key n:i", "SELECT symbol_y || '|' || symbol_x AS pair_key, 2 AS n FROM pairs WHERE group_name = 'G4'")
def m01(spark, sf):
    pairs = panels.brand_pairs(spark, sf)
    swapped = pairs.filter("group_name = 'G4'").select(F.col("symbol_x").alias("symbol_y"), F.col("symbol_y").alias("symbol_x"), "group_name")
    return portfolio.repeated_pairs(pairs.union(swapped))


@register("M02_inferred_capital", f"{KEYS} capital:2 constant", f"SELECT symbol_y, symbol_x, min({CAPITAL} + CASE WHEN group_name = 'G2' AND pos % 100 = 7 THEN 50 ELSE 0 END) AS capital, count(*) FILTER (group_name = 'G2' AND pos % 100 = 7) = 0 AS constant FROM ac GROUP BY 1, 2")
def m02(spark, sf):
    """In one group some rows have an equity that another capital would give."""
    odd = (F.col("group_name") == "G2") & (F.col("pos") % 100 == 7)
    return portfolio.inferred_capital(accounts(spark, sf).withColumn("net_equity_after_carry", F.col("net_equity_after_carry") + F.when(odd, 50).otherwise(0)), PAIR)


@register("M03_calendar_sources", "pair_id rows:i known:i", f"SELECT pair_id, count(*) AS rows, count(r) AS known FROM ({ALIGNED}) GROUP BY 1")
def m03(spark, sf):
    return aligned(spark, sf).groupBy("pair_id").agg(F.count("*").alias("rows"), F.count("r").alias("known"))


@register("M04_weights", "pair_id weight:12 allocated_capital:4", ALLOCATED)
def m04(spark, sf):
    return allocations(spark, sf)


@register("M05_allocation_rules", "pair_id reason", f"SELECT pair_id, 'capital' AS reason FROM ({ALLOCATED}) WHERE pair_id LIKE 'Brand#1|%'")
def m05(spark, sf):
    rows = allocations(spark, sf)
    return portfolio.invalid_allocations(rows.withColumn("allocated_capital", F.when(F.col("pair_id").startswith("Brand#1|"), 0.0).otherwise(F.col("allocated_capital"))), CAPITAL)


SLEEVES = f"""SELECT *, CASE WHEN dead <= pos AND NOT coalesce(bad < dead, false) THEN 0.0 WHEN bad <= pos AND NOT coalesce(dead < bad, false) THEN NULL ELSE allocated_capital * product END AS sleeve_equity, coalesce(dead <= pos AND NOT coalesce(bad < dead, false), false) AS insolvent
  FROM (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS product, min(CASE WHEN r IS NULL OR r < -1 THEN pos END) OVER (PARTITION BY pair_id) AS bad, min(CASE WHEN r = -1 THEN pos END) OVER (PARTITION BY pair_id) AS dead FROM ({ALIGNED}) JOIN ({ALLOCATED}) USING (pair_id))"""
PNL = f"SELECT *, sleeve_equity - CASE WHEN pos = 0 THEN allocated_capital ELSE lag(sleeve_equity) OVER (PARTITION BY pair_id ORDER BY pos) END AS sleeve_pnl FROM ({SLEEVES})"


@register("M06_sleeves", "pair_id pos:i sleeve_equity:4 sleeve_pnl:4 insolvent", PNL)
def m06(spark, sf):
    return shared("sleeves", lambda spark, sf: written(portfolio.sleeves(aligned(spark, sf), allocations(spark, sf))), spark, sf)


PORTFOLIO = f"""SELECT *, portfolio_pnl / CASE WHEN pos = 0 THEN {CAPITAL} ELSE lag(portfolio_equity) OVER (ORDER BY pos) END AS portfolio_return FROM (
  SELECT pos, unavailable, insolvent_sleeves, CASE WHEN max(unavailable) OVER u = 0 THEN p END AS portfolio_pnl, CASE WHEN max(unavailable) OVER u = 0 THEN e + {CAPITAL} * 0.1 END AS portfolio_equity
  FROM (SELECT pos, count(*) FILTER (sleeve_equity IS NULL) AS unavailable, count(*) FILTER (insolvent) AS insolvent_sleeves, sum(sleeve_pnl) AS p, sum(sleeve_equity) AS e FROM ({PNL}) GROUP BY 1) WINDOW u AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def portfolio_rows(spark, sf):
    return portfolio.portfolio_returns(m06(spark, sf), allocations(spark, sf), CAPITAL)


@register("M06_portfolio_returns", "pos:i unavailable:i insolvent_sleeves:i portfolio_pnl:4 portfolio_equity:4 portfolio_return:10", PORTFOLIO)
def m06b(spark, sf):
    return portfolio_rows(spark, sf)


MARKET = f"SELECT a.symbol_y, a.symbol_x, a.symbol_y || '|' || a.symbol_x AS pair_id, d.at AS pos, a.notional_y AS my, a.notional_x AS mx FROM ac a JOIN ({DAYS}) d USING (date)"


def exposures(spark, sf):
    rows = portfolio.pair_inputs(accounts(spark, sf)).join(F.broadcast(days(spark, sf)), "date")
    return rows.select("pair_id", *PAIR, F.col("at").alias("pos"), F.col("notional_y").alias("market_value_y"), F.col("notional_x").alias("market_value_x"))


LEGS = f"SELECT pos, symbol, sum(v) AS net, sum(abs(v)) AS unnetted_gross, count(DISTINCT pair_id) AS pairs FROM (SELECT pos, pair_id, symbol_y AS symbol, my AS v FROM ({MARKET}) UNION ALL SELECT pos, pair_id, symbol_x, mx FROM ({MARKET})) GROUP BY 1, 2"
TOTALS = f"""SELECT * FROM (SELECT pos, sum(abs(my) + abs(mx)) AS total_gross, sum(my + mx) AS total_net, sum(greatest(my, 0) + greatest(mx, 0)) AS total_long, sum(greatest(-my, 0) + greatest(-mx, 0)) AS total_short, count(*) FILTER (my <> 0 OR mx <> 0) AS active_pair_count FROM ({MARKET}) GROUP BY 1)
  JOIN (SELECT pos, sum(abs(net)) AS consolidated_gross, max(unnetted_gross) AS largest_symbol_gross, count(*) FILTER (pairs > 1) AS shared_symbols FROM ({LEGS}) GROUP BY 1) USING (pos)"""


@register("M07_symbol_exposures", "pos:i symbol net:4 unnetted_gross:4 pairs:i", LEGS)
def m07(spark, sf):
    return portfolio.symbol_exposures(exposures(spark, sf))


@register("M07_aggregate_exposures", "pos:i total_gross:4 total_net:4 total_long:4 total_short:4 consolidated_gross:4 largest_symbol_gross:4 shared_symbols:i active_pair_count:i", TOTALS)
def m07b(spark, sf):
    return portfolio.aggregate_exposures(exposures(spark, sf))


SCHEDULE = f"SELECT *, total_gross / portfolio_equity AS gross_exposure_ratio FROM ({PORTFOLIO}) LEFT JOIN ({TOTALS}) USING (pos)"


@register("M08_portfolio_schedule", "pos:i portfolio_equity:4 gross_exposure_ratio:10 leverage_status", f"SELECT *, CASE WHEN gross_exposure_ratio IS NULL THEN 'UNEVALUABLE' WHEN gross_exposure_ratio > 0.00010000033 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END AS leverage_status FROM ({SCHEDULE})")
def m08(spark, sf):
    return portfolio.portfolio_schedule(portfolio_rows(spark, sf), m07b(spark, sf), 0.00010000033)


LEVERED = f"SELECT pos, CASE WHEN gross_exposure_ratio IS NULL THEN 'UNEVALUABLE' WHEN gross_exposure_ratio > 0.00010000033 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END AS status, pos IN (SELECT d.at FROM ps JOIN ({DAYS}) d USING (date) WHERE execution_event <> 'NONE') AS trades FROM ({SCHEDULE})"


@register("M08_leverage_rules", "pos:i rule is_error", f"SELECT pos, rule, rule <> 'drift_breach' AS is_error FROM (SELECT pos, CASE WHEN status = 'BREACH' AND trades THEN 'execution_breach' WHEN status = 'BREACH' THEN 'drift_breach' WHEN status = 'UNEVALUABLE' AND (trades OR pos = 0) THEN 'unevaluable' END AS rule FROM ({LEVERED})) WHERE rule IS NOT NULL")
def m08b(spark, sf):
    executions = panels.schedule(spark, sf).filter("execution_event <> 'NONE'").select("date").distinct().join(F.broadcast(days(spark, sf)), "date")
    return quality.leverage_violations(m08(spark, sf), executions.select(F.col("at").alias("pos")))


@register("M09_concentration", "pairs:i funded_pairs:i invested_weight:9 cash_weight:9 hhi:9 effective_pairs:6 whole_hhi:9", f"SELECT count(*) AS pairs, count(*) AS funded_pairs, sum(weight) AS invested_weight, 1 - sum(weight) AS cash_weight, sum(weight * weight) / (sum(weight) * sum(weight)) AS hhi, sum(weight) * sum(weight) / sum(weight * weight) AS effective_pairs, sum(weight * weight) + (1 - sum(weight)) * (1 - sum(weight)) AS whole_hhi FROM ({ALLOCATED})")
def m09(spark, sf):
    return portfolio.concentration(allocations(spark, sf))


def risk_input(spark, sf):
    largest = m06(spark, sf).groupBy("pos").agg(F.max("sleeve_equity").alias("largest_sleeve_equity"))
    return m08(spark, sf).join(largest, "pos", "left")


def observed(spark, sf):
    """A row a day, which statuses, policy and reports all read."""
    return shared("observed", lambda spark, sf: written(risk.observed_metrics(risk_input(spark, sf), CAPITAL)), spark, sf)


OBSERVED = f"""SELECT *, e / peak - 1 AS drawdown, greatest(1 - e / peak, 0) AS drawdown_magnitude, e / {CAPITAL} AS portfolio_equity_ratio, total_gross / e AS gross_exposure_ratio, abs(total_net) / e AS abs_net_exposure_ratio, largest / e AS largest_pair_equity_weight
  FROM (SELECT pos, portfolio_equity AS e, total_gross, total_net, CAST(active_pair_count AS DOUBLE) AS active_pair_count, CAST(insolvent_sleeves AS DOUBLE) AS insolvent_sleeve_count, largest,
    CASE WHEN portfolio_equity IS NOT NULL THEN greatest({CAPITAL}, max(portfolio_equity) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS peak
    FROM ({PORTFOLIO}) LEFT JOIN ({TOTALS}) USING (pos) LEFT JOIN (SELECT pos, max(sleeve_equity) AS largest FROM ({SLEEVES}) GROUP BY 1) USING (pos))"""


@register("X01_observed_metrics", "pos:i gross_exposure_ratio:10 abs_net_exposure_ratio:10 largest_pair_equity_weight:9 drawdown:9 portfolio_equity_ratio:9 active_pair_count:i insolvent_sleeve_count:i", OBSERVED)
def x01(spark, sf):
    return observed(spark, sf)


LIMITS = [("active_pairs", 12.0), ("insolvent_sleeves", 0.0), ("drawdown", 0.5), ("portfolio_equity", 0.5)]
STATUS = f"""SELECT pos, 'active_pairs' AS control, active_pair_count AS value, CASE WHEN active_pair_count IS NULL THEN 'UNEVALUABLE' WHEN active_pair_count > 12 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END AS status FROM ({OBSERVED})
  UNION ALL SELECT pos, 'insolvent_sleeves', insolvent_sleeve_count, CASE WHEN insolvent_sleeve_count > 0 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END FROM ({OBSERVED})
  UNION ALL SELECT pos, 'drawdown', drawdown_magnitude, CASE WHEN drawdown_magnitude IS NULL THEN 'UNEVALUABLE' WHEN drawdown_magnitude > 0.5 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END FROM ({OBSERVED})
  UNION ALL SELECT pos, 'portfolio_equity', portfolio_equity_ratio, CASE WHEN portfolio_equity_ratio IS NULL THEN 'UNEVALUABLE' WHEN portfolio_equity_ratio < 0.5 THEN 'BREACH' ELSE 'WITHIN_LIMIT' END FROM ({OBSERVED})"""


def statuses(spark, sf):
    return risk.control_statuses(observed(spark, sf), spark.createDataFrame(LIMITS, "control string, limit double"))


@register("X02_control_statuses", "pos:i control status value:9", STATUS)
def x02(spark, sf):
    return statuses(spark, sf).filter("status <> 'NOT_CONFIGURED'")


OVERALL = f"SELECT pos, count(*) FILTER (status = 'BREACH') AS breaches, count(*) FILTER (status = 'UNEVALUABLE') AS unevaluable, CASE WHEN count(*) FILTER (status = 'BREACH') > 0 THEN 'BREACH' WHEN count(*) FILTER (status = 'UNEVALUABLE') > 0 THEN 'UNEVALUABLE' ELSE 'WITHIN_LIMIT' END AS overall_status FROM ({STATUS}) GROUP BY 1"


@register("X02_overall_status", "pos:i breaches:i unevaluable:i overall_status", OVERALL)
def x02b(spark, sf):
    return risk.overall_status(statuses(spark, sf))


def policy(spark, sf):
    return risk.risk_policy(x02b(spark, sf), observed(spark, sf), "LIQUIDATE_ALL")


@register("X03_risk_policy", "pos:i risk_state requested_action intent", f"SELECT pos, CASE WHEN pos > f THEN 'LIQUIDATION_REQUIRED' ELSE 'NORMAL' END AS risk_state, CASE WHEN pos = f + 1 THEN 'LIQUIDATE_ALL' ELSE 'NONE' END AS requested_action, CASE WHEN pos = f THEN 'LIQUIDATE_ALL' ELSE 'NONE' END AS intent FROM (SELECT DISTINCT pos FROM ({OBSERVED})), (SELECT min(pos) AS f FROM ({STATUS}) WHERE status = 'BREACH')")
def x03(spark, sf):
    return policy(spark, sf)


@register("X04_breach_records", "pos:i control value:9 intent", f"SELECT s.pos, control, value, CASE WHEN s.pos = (SELECT min(pos) FROM ({STATUS}) WHERE status = 'BREACH') THEN 'LIQUIDATE_ALL' ELSE 'NONE' END AS intent FROM ({STATUS}) s WHERE status = 'BREACH'")
def x04(spark, sf):
    return risk.breach_records(statuses(spark, sf), policy(spark, sf))


@register("X05_risk_schedule", "pos:i drawdown:9 overall_status risk_state", f"SELECT o.pos, o.drawdown, s.overall_status, CASE WHEN o.pos > f THEN 'LIQUIDATION_REQUIRED' ELSE 'NORMAL' END AS risk_state FROM ({OBSERVED}) o JOIN ({OVERALL}) s USING (pos), (SELECT min(pos) AS f FROM ({STATUS}) WHERE status = 'BREACH')")
def x05(spark, sf):
    return risk.risk_schedule(observed(spark, sf), x02b(spark, sf), policy(spark, sf))


@register("X06_risk_summary", "control breaches:i first_breach:i last_breach:i unevaluable:i highest:9 lowest:9", f"SELECT control, count(*) FILTER (status = 'BREACH') AS breaches, min(pos) FILTER (status = 'BREACH') AS first_breach, max(pos) FILTER (status = 'BREACH') AS last_breach, count(*) FILTER (status = 'UNEVALUABLE') AS unevaluable, max(value) AS highest, min(value) AS lowest FROM ({STATUS}) GROUP BY 1")
def x06(spark, sf):
    return risk.risk_summary(x02(spark, sf))


#: A limit per supplier: a control by its key, and a value out of its balance.
CHOSEN = "CASE s_suppkey % 3 WHEN 0 THEN 'drawdown' WHEN 1 THEN 'active_pairs' ELSE 'speed' END"


@register("X07_invalid_limits", "s_suppkey:i control reason", f"SELECT s_suppkey, control, CASE WHEN control = 'speed' THEN 'unknown_control' ELSE 'value' END AS reason FROM (SELECT s_suppkey, {CHOSEN} AS control, round(s_acctbal) AS v FROM supplier) WHERE control = 'speed' OR v < 0")
def x07(spark, sf):
    limits = panels.table(spark, sf, "supplier").select("s_suppkey", F.expr(CHOSEN).alias("control"), F.round("s_acctbal").alias("limit"))
    return risk.invalid_limits(limits, ("s_suppkey",))


@register("X08_risk_run", "control breaches:i unevaluable:i", f"""SELECT control, count(*) FILTER (status = 'BREACH') AS breaches, count(*) FILTER (status = 'UNEVALUABLE') AS unevaluable FROM ({STATUS}) GROUP BY 1
  UNION ALL SELECT control, 0, 0 FROM (VALUES ('gross_exposure'), ('net_exposure'), ('pair_weight'), ('symbol_exposure'), ('long_exposure'), ('short_exposure')) v(control) WHERE (SELECT count(*) FROM px) > 0""")
def x08(spark, sf):
    return risk.risk_summary(statuses(spark, sf))


@register("Q07_portfolio_identities", "pos:i rule", f"SELECT pos, CASE WHEN pos % 50 = 10 THEN 'equity' ELSE 'pnl' END AS rule FROM ({PORTFOLIO}) WHERE portfolio_equity IS NOT NULL AND pos % 50 IN (10, 20)")
def q07(spark, sf):
    """Some rows of the portfolio have another equity, others another P&L, than their sleeves."""
    rows = written(portfolio_rows(spark, sf))
    more = lambda c, at, by: F.when(F.col("pos") % 50 == at, F.col(c) + by).otherwise(F.col(c))
    return quality.portfolio_violations(m06(spark, sf), rows.withColumns({"portfolio_equity": more("portfolio_equity", 10, 5), "portfolio_pnl": more("portfolio_pnl", 20, 1)}), 0.1, CAPITAL)


@register("Q08_risk_rules", "pos:i rule", f"SELECT pos, 'intent_without_breach' AS rule FROM ({OVERALL}) WHERE breaches = 0 AND pos % 9 = 3")
def q08(spark, sf):
    """Every ninth row has an intent; those without a breach are found."""
    p = policy(spark, sf)
    return quality.risk_violations(statuses(spark, sf), p.withColumn("intent", F.when(F.col("pos") % 9 == 3, "LIQUIDATE_ALL").otherwise(F.col("intent")))).filter("rule = 'intent_without_breach'")


@register("Q08_breach_records", "pos:i control rule", f"SELECT pos, control, CASE pos % 7 WHEN 0 THEN 'missing' ELSE 'repeated' END AS rule FROM ({STATUS}) WHERE status = 'BREACH' AND pos % 7 < 2 UNION ALL SELECT pos, control, 'no_breach' FROM ({STATUS}) WHERE status = 'UNEVALUABLE'")
def q08b(spark, sf):
    """Records of some breaches are lost, others written twice, and rows that could not be evaluated have one."""
    s = x02(spark, sf)
    records = risk.breach_records(s, policy(spark, sf)).select("pos", "control").filter("pos % 7 <> 0")
    return quality.breach_record_violations(s, records.union(records.filter("pos % 7 = 1")).union(s.filter("status = 'UNEVALUABLE'").select("pos", "control")))


@register("Q08_actions", "pos:i rule", f"""SELECT pos + 3 AS pos, 'action_without_intent' AS rule FROM (SELECT min(pos) AS pos FROM ({STATUS}) WHERE status = 'BREACH') WHERE pos IS NOT NULL UNION ALL SELECT pos, 'intent_without_action' FROM (SELECT min(pos) AS pos FROM ({STATUS}) WHERE status = 'BREACH') WHERE pos IS NOT NULL
  UNION ALL SELECT s.pos, CASE status WHEN 'WITHIN_LIMIT' THEN 'breach_within_limit' WHEN 'BREACH' THEN 'beyond_limit_unnoticed' ELSE 'unknown_within_limit' END FROM ({STATUS}) s WHERE s.control = 'active_pairs' AND s.pos % 11 = 4""")
def q08c(spark, sf):
    """An action comes two rows late; some values within their limit are called breaches, and breaches and unknown values within it."""
    s, p = statuses(spark, sf), policy(spark, sf)
    wrong = (F.col("control") == "active_pairs") & (F.col("pos") % 11 == 4)
    late = F.lag("requested_action", 2, "NONE").over(Window.partitionBy(F.lit(1)).orderBy("pos"))
    changed = s.withColumn("status", F.when(wrong, F.when(F.col("status") == "WITHIN_LIMIT", "BREACH").otherwise("WITHIN_LIMIT")).otherwise(F.col("status")))
    return quality.risk_violations(changed, p.withColumn("requested_action", late)).filter("rule <> 'intent_without_breach'")


@register("Q09_run_counts", "rule", "SELECT 'known' AS rule FROM (SELECT count(*) AS n FROM rt) WHERE n % 2 = 0 UNION ALL SELECT CASE n % 2 WHEN 0 THEN 'folds' ELSE 'rows' END FROM (SELECT count(*) AS n FROM rt)")
def q09(spark, sf):
    """Which counts of a report are wrong depends on how many rows there are."""
    rows = yearly(spark, sf).withColumn("status", F.lit("COMPLETED"))
    even = (F.col("scheduled_rows") % 2 == 0).cast("int")
    wrong = walkforward.coverage(rows).withColumns({"known_rows": F.col("known_rows") - even, "folds": F.col("folds") + even, "scheduled_rows": F.col("scheduled_rows") - 1 + even})
    return quality.run_violations(rows, wrong)


@register("Q10_whole_run", "rule n:i")
def q10(spark, sf):
    rows = accounts(spark, sf)
    a = quality.accounting_violations(rows, CAPITAL).select(F.lit("accounting").alias("rule"))
    b = quality.execution_violations(rows).select(F.lit("execution").alias("rule"))
    c = quality.screening_violations(s07(spark, sf)).select(F.lit("screening").alias("rule"))
    found = a.union(b).union(c).groupBy("rule").agg(F.count("*").alias("n"))
    checks = spark.createDataFrame([("accounting",), ("execution",), ("screening",)], "rule string")
    return checks.join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


# --- reports and jobs ------------------------------------------------------------------------------------------------
@register("G01_selected_pairs", "run_id symbol_y symbol_x rank:i corrected_p:6")
def g01(spark, sf):
    return store.load_screening(s07(spark, sf), "run-b", True)


@register("G02_selection_by_group", "group_name pairs:i selected:i selection_rate:9")
def g02(spark, sf):
    return store.selection_by_group(s07_full(spark, sf))


def s07_full(spark, sf):
    from quantmill.plans.catalog_core import screening_batch

    batch = screening_batch(spark, sf)
    return store.store_screening(batch.limit(0).withColumn("half_life_was_infinite", F.lit(False)), batch)


@register("G03_most_selected", f"{KEYS} runs:i")
def g03(spark, sf):
    return store.most_selected(s07_full(spark, sf))


@register("G04_mean_diagnostics", f"{KEYS} mean_p:6 mean_half_life:4 mean_hurst:6 n:i")
def g04(spark, sf):
    return store.mean_diagnostics(s07_full(spark, sf))


@register("G05_rejection_counts", "reason pairs:i")
def g05(spark, sf):
    return store.rejection_counts(s07_full(spark, sf).withColumn("rejection_reasons", F.to_json("rejection_reasons")))


@register("G06_run_summary", "run_id pairs:i selected:i mean_p:6 median_half_life:4 worst_rank:i")
def g06(spark, sf):
    return store.run_summary(s07_full(spark, sf))


def _research(spark, sf):
    rows = written(fold_panel(spark, sf))
    few = scenarios(spark, sf).filter("is_baseline or (exit_z = 0.5 and zscore_lookback = 60 and formation_window = 504)")  # the entry thresholds
    plan = jobs.Request(mark_folds(spark, sf), RULES, scenarios=few, dates=marks(spark, sf).select("date").distinct().count(), options={"target": panels.NOTIONAL})
    return jobs.research(rows, plan, jobs.run_store(f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"), "run-1")


def research(spark, sf):
    return shared("research", _research, spark, sf)


@register("O01_research_job", "folds:i completed:i scheduled_rows:i known_rows:i selected_pairs:i diagnostic_rows:i scenarios:i completed_scenarios:i psr:6")
def o01(spark, sf):
    """What a whole run has come to: walk-forward, screening, diagnostic, grid and validation."""
    run = research(spark, sf)
    chosen = run["screening"].agg(F.count_if("selected").alias("selected_pairs"))
    diagnosed = run["diagnostic"].agg(F.count("*").alias("diagnostic_rows"))
    grids = run["grid"].agg(F.count("*").alias("scenarios"), F.count_if(F.col("status") == "COMPLETED").alias("completed_scenarios"))
    return run["coverage"].join(chosen, how="left").join(diagnosed, how="left").join(grids, how="left").join(run["validation"].select("psr"), how="left")  # one row each


@register("O01_stages", "run_id stage status rows:i reason")
def o01b(spark, sf):
    """The durable record of the run, read back from its store."""
    return research(spark, sf)["record"]


SETTINGS = """SELECT run_id, '{"entry_z":2.0,' || CASE WHEN orders % 2 = 0 THEN '"gross_leverage_cap":1.5,' ELSE '' END || '"orders":' || CAST(orders AS VARCHAR) || '}' AS settings, CASE WHEN orders % 2 = 0 THEN 'gross_leverage_cap' ELSE '' END AS unenforced
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS orders FROM orders GROUP BY 1)"""


@register("O02_configuration_snapshot", "run_id settings unenforced digest", f"SELECT *, sha256(settings) AS digest FROM ({SETTINGS})")
def o02(spark, sf):
    """A run a month of orders; every other one sets a limit that no stage applies."""
    runs = panels.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).agg(F.count("*").alias("orders"))
    return jobs.configuration_snapshots(runs.withColumns({"entry_z": F.lit(2.0), "gross_leverage_cap": F.when(F.col("orders") % 2 == 0, 1.5)}))

"""Walk-forward evaluation of all folds in one plan: screen, freeze, trade, and put the calendar together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.durable import written
from quantmill.operators import accounting, hedge, metrics, positions, signals
from quantmill.operators.panel import in_fold

PAIR = ("symbol_y", "symbol_x")


def formation_eligible(prices: DataFrame, folds: DataFrame, minimum: int) -> DataFrame:
    """Symbols per fold with enough usable prices in its formation rows.  prices: symbol, pos, price."""
    rows = in_fold(prices, folds, "formation")
    return rows.groupBy("fold_id", "symbol").agg(F.count("price").alias("usable"), F.count_if(F.col("price") <= 0).alias("bad")).filter((F.col("usable") >= minimum) & (F.col("bad") == 0)).select("fold_id", "symbol", "usable")


def possible_groups(eligible: DataFrame, universe: DataFrame) -> DataFrame:
    """Groups per fold that two eligible symbols or more are left of."""
    return eligible.join(universe, "symbol").groupBy("fold_id", "group_name").agg(F.count("*").alias("symbols")).filter("symbols >= 2")


def group_snapshots(prices: DataFrame, folds: DataFrame, universe: DataFrame, keys: tuple = ("fold_id",), minimum: int = 100) -> DataFrame:
    """(keys, group_name, symbols): the eligible symbols of each group in each fold's formation rows, comma-joined in order."""
    rows = in_fold(prices, folds, "formation").groupBy(*keys, "symbol").agg(F.count("price").alias("usable"), F.count_if(F.col("price") <= 0).alias("bad")).filter((F.col("usable") >= minimum) & (F.col("bad") == 0))
    return rows.join(universe, "symbol").groupBy(*keys, "group_name").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


def formation_screen(panel: DataFrame, folds: DataFrame, keys: tuple = ("fold_id",), minimum: int = 100, fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5) -> DataFrame:
    """Screening of every pair in the formation rows of every fold; written, since status and trading read it."""
    return written(hedge.screen_windows(in_fold(panel, folds, "formation"), keys, minimum, fdr, longest, hurst_limit))


def trade_folds(panel: DataFrame, chosen: DataFrame, rules: signals.Rules, lookbacks: list[int], keys: tuple, target: float = 100_000.0, capital: float = 1_000_000.0, costs: dict | None = None) -> DataFrame:
    """Accounting rows over trading rows of what ``chosen`` names.

    chosen: keys, pair, alpha, hedge_ratio, lookback (one of ``lookbacks``) and fold bounds; columns that ``rules``
    refers to are its own.  The z-scores of the first trading rows look back into formation.
    """
    own = (*keys, *PAIR)
    rows = panel.join(chosen, list(PAIR)).filter(F.col("pos").between(F.col("trading_start_pos") - max(lookbacks), F.col("trading_end_pos")))
    rows = rows.filter(F.col("pos") >= F.greatest(F.col("formation_start_pos"), F.col("trading_start_pos") - F.col("lookback")))
    rows = rows.withColumn("spread", F.ln("price_y") - F.col("alpha") - F.col("hedge_ratio") * F.ln("price_x"))
    for n in lookbacks:
        rows = signals.standardise(rows, n, own).withColumnRenamed("zscore", f"z{n}").drop("rolling_mean", "rolling_std")
    rows = rows.withColumn("zscore", F.coalesce(*[F.when(F.col("lookback") == n, F.col(f"z{n}")) for n in lookbacks])).drop(*[f"z{n}" for n in lookbacks]).filter("pos >= trading_start_pos")
    for leg in "yx":
        if f"observed_{leg}" not in rows.columns:
            rows = rows.withColumn(f"observed_{leg}", F.col(f"price_{leg}").isNotNull())
    rows = written(rows)  # read for the fills and for what they are joined to
    ready = rows.withColumn("tradable", F.col("observed_y") & F.col("observed_x")).withColumn("sized", F.col("hedge_ratio") > 0)
    fills = signals.filled_signals(ready, rules, 1, True, own).drop("zscore")
    schedule = positions.position_schedule(rows.join(fills, [*own, "pos"]), target, own)
    return accounting.financed_schedule(positions.force_close(schedule, own), capital, **(costs or {}), keys=own)


def run_folds(panel: DataFrame, folds: DataFrame, rules: signals.Rules, lookback: int = 60, minimum: int = 100, fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5, target: float = 100_000.0, capital: float = 1_000_000.0, costs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(screening of every fold, accounting rows of each fold's rank-1 pair over its trading rows), keyed by fold_id and pair.

    ``panel`` numbers rows by a calendar that all pairs share (``pos``).  Alpha and beta come from formation rows alone.
    """
    screened = formation_screen(panel, folds, ("fold_id",), minimum, fdr, longest, hurst_limit)
    chosen = screened.filter("rank = 1").select("fold_id", *PAIR, "alpha", F.col("beta").alias("hedge_ratio"), F.lit(lookback).alias("lookback")).join(folds, "fold_id")
    return screened, written(trade_folds(panel, chosen, rules, [lookback], ("fold_id",), target, capital, costs))


def run_grid(panel: DataFrame, scenarios: DataFrame, folds: DataFrame, lookbacks: list[int], minimum: int = 100, fdr: float = 0.05, longest: float = 60.0, hurst_limit: float = 0.5, target: float = 100_000.0, capital: float = 1_000_000.0, costs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(calendar, accounting rows) of a walk-forward of every scenario, all in one plan keyed by scenario_id and fold_id.

    Screening depends on the formation window alone, so it runs once for each, not for each scenario.  ``folds`` has
    the folds of each scenario.
    """
    bounds = ("formation_start_pos", "formation_end_pos", "trading_start_pos", "trading_end_pos")
    folds = folds.join(scenarios.select("scenario_id", "formation_window", "entry_z", "exit_z", "stop_z", F.col("zscore_lookback").alias("lookback")), "scenario_id")
    windows = folds.select("formation_window", "fold_id", *bounds).distinct()
    screened = formation_screen(panel, windows, ("formation_window", "fold_id"), minimum, fdr, longest, hurst_limit)
    best = screened.filter("rank = 1").select("formation_window", "fold_id", *PAIR, "alpha", F.col("beta").alias("hedge_ratio"))
    rules = signals.Rules(F.col("entry_z"), F.col("exit_z"), F.col("stop_z"))
    traded = written(trade_folds(panel, folds.join(best, ["formation_window", "fold_id"]), rules, lookbacks, ("scenario_id", "fold_id"), target, capital, costs))
    tested = folds.join(screened.filter("corrected_p is not null").select("formation_window", "fold_id").distinct(), ["formation_window", "fold_id"], "left_semi")
    keys = ("scenario_id", "fold_id")
    return written(calendar_returns(fold_status(folds, tested, traded, keys), traded, keys=keys)), traded


def fold_status(folds: DataFrame, tested: DataFrame, traded: DataFrame, keys: tuple = ("fold_id",)) -> DataFrame:
    """COMPLETED, NO_SELECTION or INSUFFICIENT_DATA per fold (the latter where no pair could be tested)."""
    tested = tested.select(*keys).distinct().withColumn("tested", F.lit(True))
    done = traded.select(*keys).distinct().withColumn("done", F.lit(True))
    out = folds.join(tested, list(keys), "left").join(done, list(keys), "left")
    return out.withColumn("status", F.when(F.col("done"), "COMPLETED").when(F.col("tested"), "NO_SELECTION").otherwise("INSUFFICIENT_DATA")).drop("tested", "done")


def gaps(folds: DataFrame, keys: tuple = ()) -> DataFrame:
    """Folds whose trading rows do not begin where those of the fold before end: returns of such folds cannot be joined."""
    before = F.lag("trading_end_pos").over(Window.partitionBy(*keys).orderBy("fold_id"))
    return folds.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("trading_start_pos") != F.col("_before") + 1)).drop("_before")


def calendar_returns(status: DataFrame, traded: DataFrame, returns: str = "net_return_after_carry", keys: tuple = ("fold_id",)) -> DataFrame:
    """A row per scheduled trading row: the fold's return, 0 where nothing was selected, null where data lacked.

    Folds must be contiguous; a row of a fold that is not (see gaps) raises an error when it is computed.
    """
    before = F.lag("trading_end_pos").over(Window.partitionBy(*keys[:-1]).orderBy("fold_id"))
    broken = F.coalesce(F.col("trading_start_pos") != before + 1, F.lit(False))
    status = status.withColumn("trading_start_pos", F.when(broken, F.raise_error(F.lit("folds are not contiguous")).cast("long")).otherwise(F.col("trading_start_pos")))
    spine = status.withColumn("pos", F.explode(F.sequence("trading_start_pos", "trading_end_pos")))
    rows = spine.join(traded.select(*keys, "pos", F.col(returns).alias("_r")), [*keys, "pos"], "left")
    return rows.select(*keys, "pos", "status", F.when(F.col("status") == "COMPLETED", F.col("_r")).when(F.col("status") == "NO_SELECTION", 0.0).alias("r"))


def conditional_returns(calendar: DataFrame) -> DataFrame:
    """Rows of executed folds only."""
    return calendar.filter("status = 'COMPLETED'")


def coverage(calendar: DataFrame, keys: tuple = ()) -> DataFrame:
    """Counts of folds by status and of rows, known and executed, and the share of rows that are known."""
    of = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("fold_id")))
    return calendar.groupBy(*keys).agg(
        F.count_distinct("fold_id").alias("folds"), of("COMPLETED").alias("completed"), of("NO_SELECTION").alias("no_selection"), of("INSUFFICIENT_DATA").alias("insufficient"),
        F.count("*").alias("scheduled_rows"), F.count("r").alias("known_rows"), F.count_if(F.col("status") == "COMPLETED").alias("executed_rows"), (F.count("r") / F.count("*")).alias("coverage"),
    )


def return_report(returns: DataFrame, keys: tuple, periods: int = 252, rate: float = 0.0) -> DataFrame:
    """Core and drawdown figures with AVAILABLE, UNAVAILABLE (fewer than 2 returns) or FAILED (a return of -1 or less), and the reason.

    ``complete`` says that no return is unknown; where some are, the figures are those of the known ones.
    """
    base = returns.groupBy(*keys).agg(F.count("r").alias("n"), F.min("r").alias("least"), F.count_if(F.col("r").isNull()).alias("unknown"))
    able = returns.join(base.filter((F.col("n") >= 2) & (F.col("least") > -1)).select(*keys), list(keys), "left_semi")
    out = base.join(metrics.core_metrics(able, keys, periods, rate), list(keys), "left").join(metrics.drawdown_metrics(able, keys, periods).drop("observations"), list(keys), "left")
    return out.withColumn("availability", F.when(F.col("n") < 2, "UNAVAILABLE").when(F.col("least") <= -1, "FAILED").otherwise("AVAILABLE")).withColumn("reason", F.when(F.col("n") < 2, "fewer_than_two_returns").when(F.col("least") <= -1, "return_of_minus_one")).withColumn("complete", F.col("unknown") == 0).drop("n", "least", "unknown")


def scenario_reports(scenarios: DataFrame, calendar: DataFrame, traded: DataFrame) -> DataFrame:
    """A row per scenario: INVALID with its error, or the report of its calendar with trades and rows of unknown cost.

    scenarios: with ``error``, null if they may run.  Figures of the calendar come only if no return of it is unknown.
    """
    key = ("scenario_id",)
    report = return_report(calendar, key).join(coverage(calendar, key), "scenario_id")
    trades = traded.groupBy(*key).agg(F.count_if(F.col("execution_event").startswith("ENTER")).alias("trades"), F.count("transaction_cost").alias("known_costs"), F.count_if(F.col("transaction_cost").isNull()).alias("unknown_costs"))
    out = scenarios.join(report, "scenario_id", "left").join(trades, "scenario_id", "left")
    status = F.when(F.col("error").isNotNull(), "INVALID").when(F.col("availability").isNull(), "NO_FOLDS").when(F.col("availability") == "FAILED", "FAILED").when(~F.col("complete"), "INCOMPLETE").otherwise("COMPLETED")
    out = out.withColumn("status", status)
    for c in ("total_return", "annualized_volatility", "sharpe_ratio", "maximum_drawdown"):
        out = out.withColumn(c, F.when(F.col("status") == "COMPLETED", F.col(c)))
    return out.withColumn("trades", F.coalesce("trades", F.lit(0)))

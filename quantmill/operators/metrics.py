"""Performance figures of return series, ledgers and rolling windows.

Return tables have ``keys``, ``pos`` and ``r``.  Nulls are dropped before anything else, except in rolling windows,
where a null makes the window null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.windows import by, cum, known_sum, near_zero, ratio, trail

PAIR = ("symbol_y", "symbol_x")
UNDER = 1e-12


def per_period(rate: float, periods: int) -> float:
    """A yearly risk-free rate as a rate per period."""
    return math.expm1(math.log1p(rate) / periods)


def core_metrics(returns: DataFrame, keys: tuple = PAIR, periods: int = 252, rate: float = 0.0) -> DataFrame:
    """total_return, annualized_return, annualized_volatility, sharpe, downside_deviation, sortino, observations."""
    free, r = per_period(rate, periods), F.col("r")
    scale, excess = F.max(F.abs(r)), F.avg(r) - F.lit(free)
    growth = F.sum(F.log1p(r))
    below = F.sqrt(F.avg(F.pow(F.least(r - F.lit(free), F.lit(0.0)), F.lit(2.0))))
    root = math.sqrt(periods)
    out = returns.filter("r is not null").groupBy(*keys).agg(
        F.count("*").alias("observations"), F.expm1(growth).alias("total_return"), F.expm1(growth * periods / F.count("*")).alias("annualized_return"),
        (F.stddev_samp(r) * root).alias("annualized_volatility"), (ratio(excess, F.stddev_samp(r), scale) * root).alias("sharpe_ratio"),
        (below * root).alias("downside_deviation"), (ratio(excess, below, scale) * root).alias("sortino_ratio"),
    )
    return out


def equity_and_drawdown(returns: DataFrame, keys: tuple = PAIR, capital: float = 1.0) -> DataFrame:
    """equity = capital times the running product of 1 + r, peak so far (capital at least), drawdown; positions renumbered."""
    rows = returns.filter("r is not null").withColumn("n", F.row_number().over(by(keys)) - 1)
    rows = rows.withColumn("equity", F.lit(capital) * F.product(1 + F.col("r")).over(cum(keys)))
    rows = rows.withColumn("peak", F.greatest(F.max("equity").over(cum(keys)), F.lit(capital)))
    return rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def drawdown_episodes(returns: DataFrame, keys: tuple = PAIR, capital: float = 1.0) -> DataFrame:
    """One row per time under water: peak (null: the start), start, first deepest row, recovery (null: none), depth, duration.

    Positions are those of the rows (``pos``); duration counts retained rows from the peak.
    """
    rows = equity_and_drawdown(returns, keys, capital)
    w = by(keys, "n")
    under = F.col("equity") < F.col("peak") * (1 - UNDER)  # running products of equal values may differ in the last bits
    rows = rows.withColumn("under", under)
    last_top = F.last(F.when(~F.col("under"), F.struct("n", "pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_top = F.first(F.when(~F.col("under"), F.struct("n", "pos")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("top", last_top).withColumn("next", next_top).withColumn("end", F.max("n").over(Window.partitionBy(*keys)))
    rows = rows.filter("under").withColumn("top_n", F.coalesce(F.col("top.n"), F.lit(-1)))
    out = rows.groupBy(*keys, "top_n").agg(
        F.first("top.pos").alias("peak_pos"), F.min("pos").alias("start_pos"), F.min(F.struct(F.round("drawdown", 12).alias("depth"), "n", "pos")).alias("deepest"), F.min("drawdown").alias("depth"), F.first("next").alias("next"), F.first("end").alias("end"),
    )
    duration = F.coalesce(F.col("next.n"), F.col("end")) - F.col("top_n")
    return out.select(*keys, "peak_pos", "start_pos", F.col("deepest.pos").alias("trough_pos"), F.col("next.pos").alias("recovery_pos"), F.col("depth").alias("maximum_drawdown"), duration.cast("long").alias("duration"), F.col("next").isNotNull().alias("recovered"))


def drawdown_metrics(returns: DataFrame, keys: tuple = PAIR, periods: int = 252, capital: float = 1.0) -> DataFrame:
    """Deepest episode (the first at a tie), longest duration, calmar, current drawdown and rows under water."""
    rows = equity_and_drawdown(returns, keys, capital)
    curve = rows.groupBy(*keys).agg(F.count("*").alias("observations"), F.min(F.least("drawdown", F.lit(0.0))).alias("maximum_drawdown"), F.max_by("drawdown", "n").alias("current_drawdown"), F.count_if(F.col("drawdown") < -UNDER).alias("underwater_observations"))
    episodes = drawdown_episodes(returns, keys, capital)
    deepest = Window.partitionBy(*keys).orderBy("maximum_drawdown", "start_pos")
    episodes = episodes.withColumn("k", F.row_number().over(deepest)).withColumn("longest_drawdown_duration", F.max("duration").over(Window.partitionBy(*keys))).filter("k = 1")
    episodes = episodes.select(*keys, F.col("peak_pos").alias("maximum_drawdown_start"), F.col("trough_pos").alias("maximum_drawdown_trough"), F.col("recovery_pos").alias("maximum_drawdown_recovery"), F.col("duration").alias("maximum_drawdown_duration"), "longest_drawdown_duration")
    out = curve.join(episodes, list(keys), "left")
    yearly = core_metrics(returns, keys, periods).select(*keys, "annualized_return")
    out = out.join(yearly, list(keys), "left").withColumn("calmar_ratio", ratio(F.col("annualized_return"), -F.col("maximum_drawdown"), F.lit(1.0)))
    for c in ("maximum_drawdown_duration", "longest_drawdown_duration"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
    return out.drop("annualized_return")


def classified_trades(ledger: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """class: winner, loser or breakeven, by net P&L against the largest of the key; null if it is unknown."""
    scale = F.max(F.abs("net_pnl")).over(Window.partitionBy(*keys))
    kind = F.when(F.col("net_pnl").isNull(), None).when(near_zero(F.col("net_pnl"), scale), "breakeven").when(F.col("net_pnl") > 0, "winner").otherwise("loser")
    return ledger.withColumn("class", kind)


def trade_metrics(ledger: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Win rate, averages, payoff, expectancy, profit factor, holding periods and total P&L per key."""
    c, pnl = F.col("class"), F.col("net_pnl")
    of = lambda kind, f: f(F.when(c == kind, pnl))
    out = classified_trades(ledger, keys).groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count(c).alias("known_trades"), F.try_divide(F.count_if(c == "winner"), F.count(c)).alias("win_rate"),
        of("winner", F.avg).alias("average_winner"), of("loser", F.avg).alias("average_loser"), F.avg(pnl).alias("expectancy"),
        of("winner", F.sum).alias("_won"), of("loser", F.sum).alias("_lost"), F.avg("holding_period_rows").alias("average_holding"), F.median("holding_period_rows").alias("median_holding"), known_sum(pnl).alias("total_net_pnl"),
    )
    out = out.withColumn("payoff_ratio", F.col("average_winner") / -F.col("average_loser")).withColumn("profit_factor", F.coalesce("_won", F.lit(0.0)) / -F.col("_lost"))
    return out.drop("_won", "_lost")


def turnover(accounting: DataFrame, capital: float, keys: tuple = PAIR) -> DataFrame:
    return accounting.groupBy(*keys).agg((known_sum(F.col("traded_notional_y") + F.col("traded_notional_x")) / F.lit(capital)).alias("turnover"))


def rolling_metrics(returns: DataFrame, window: int, keys: tuple = PAIR, periods: int = 252, rate: float = 0.0) -> DataFrame:
    """rolling_volatility, rolling_sharpe, rolling_sortino over the ``window`` rows up to each row; a null poisons them."""
    w, r, free, root = trail(keys, window), F.col("r"), per_period(rate, periods), math.sqrt(periods)
    scale, std = F.max(F.abs(r)).over(w), F.stddev_samp(r).over(w)
    below = F.sqrt(F.avg(F.pow(F.least(r - F.lit(free), F.lit(0.0)), F.lit(2.0))).over(w))
    excess, full = F.avg(r).over(w) - F.lit(free), F.count(r).over(w) == window
    out = returns.withColumn("rolling_volatility", F.when(full, std * root))
    out = out.withColumn("rolling_sharpe", F.when(full, ratio(excess, std, scale) * root))
    return out.withColumn("rolling_sortino", F.when(full, ratio(excess, below, scale) * root))


def rolling_drawdown(returns: DataFrame, keys: tuple = PAIR, capital: float = 1.0) -> DataFrame:
    """The current drawdown on every row, null where the return is."""
    w = cum(keys)
    equity = F.lit(capital) * F.product(1 + F.coalesce("r", F.lit(0.0))).over(w)
    rows = returns.withColumn("_equity", equity)
    peak = F.greatest(F.max("_equity").over(w), F.lit(capital))
    return rows.withColumn("drawdown", F.when(F.col("r").isNotNull(), F.col("_equity") / peak - 1)).drop("_equity")


def benchmark_metrics(rows: DataFrame, keys: tuple = PAIR, periods: int = 252, rate: float = 0.0) -> DataFrame:
    """beta, alpha, tracking_error, information_ratio, correlation of r against b, on rows that have both."""
    free, root, r, b = per_period(rate, periods), math.sqrt(periods), F.col("r"), F.col("b")
    active = r - b
    beta = ratio(F.covar_samp(r, b), F.var_samp(b), F.max(b * b))
    out = rows.filter("r is not null and b is not null").groupBy(*keys).agg(
        F.count("*").alias("observations"), beta.alias("beta"), F.avg(r).alias("_r"), F.avg(b).alias("_b"), (F.stddev_samp(active) * root).alias("tracking_error"),
        (ratio(F.avg(active), F.stddev_samp(active), F.max(F.abs(active))) * root).alias("information_ratio"), F.when(~near_zero(F.stddev_samp(r), F.max(F.abs(r))) & ~near_zero(F.stddev_samp(b), F.max(F.abs(b))), F.covar_samp(r, b) / (F.stddev_samp(r) * F.stddev_samp(b))).alias("correlation"),
    )
    return out.withColumn("alpha", ((F.col("_r") - free) - F.col("beta") * (F.col("_b") - free)) * periods).drop("_r", "_b")


def performance_report(returns: DataFrame, ledger: DataFrame, keys: tuple = PAIR, periods: int = 252, rate: float = 0.0, benchmark: DataFrame | None = None, accounting: DataFrame | None = None, capital: float | None = None) -> DataFrame:
    """Core, drawdown and trade figures, a row per key; with a benchmark (date, b) and accounting also those against them."""
    out = core_metrics(returns, keys, periods, rate).join(drawdown_metrics(returns, keys, periods).drop("observations"), list(keys), "left")
    out = out.join(trade_metrics(ledger, keys), list(keys), "left")
    if benchmark is not None:
        out = out.join(benchmark_metrics(returns.join(benchmark, "date"), keys, periods, rate).withColumnRenamed("observations", "benchmark_observations"), list(keys), "left")
    if accounting is not None:
        out = out.join(turnover(accounting, capital, keys), list(keys), "left")
    return out

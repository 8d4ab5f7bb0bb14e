"""P&L, costs and carry of position schedules, one window pass per key.

Unknown is null and stays apart from zero: an interval with a missing price has null P&L if units were held, and
cumulative figures are null from the first unknown on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.functions.windows import by, cum, latched_sum

PAIR = ("symbol_y", "symbol_x")


def position_pnl(rows: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """pnl_y, pnl_x, gross_pnl: units of the row before times the price change; zero units give zero."""
    w = by(keys)
    for leg in "yx":
        units, change = F.lag(f"units_{leg}").over(w), F.col(f"price_{leg}") - F.lag(f"price_{leg}").over(w)
        rows = rows.withColumn(f"pnl_{leg}", F.when(F.coalesce(units, F.lit(0.0)) == 0, 0.0).otherwise(units * change))
    return rows.withColumn("gross_pnl", F.col("pnl_y") + F.col("pnl_x"))


def split_pnl(rows: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """trade_id, realised_pnl (on the closing row), unrealised_pnl (since entry), cumulative_realised_pnl."""
    w, open_ = by(keys), F.col("executed_state") != "FLAT"
    before = F.coalesce(F.lag("executed_state").over(w), F.lit("FLAT")) != "FLAT"
    rows = rows.withColumn("_open", open_).withColumn("_closing", before & ~open_).withColumn("_entry", open_ & ~before)
    rows = rows.withColumn("_trade", F.sum(F.col("_entry").cast("int")).over(cum(keys)))
    rows = rows.withColumn("trade_id", F.when(F.col("_open") | F.col("_closing"), F.col("_trade")))
    held = F.when(F.col("_entry"), 0.0).otherwise(F.col("gross_pnl"))
    rows = rows.withColumn("_held", F.when(F.col("trade_id").isNotNull(), held).otherwise(0.0))
    within = latched_sum(F.col("_held"), cum((*keys, "trade_id")))
    rows = rows.withColumn("_within", F.when(F.col("trade_id").isNotNull(), within))
    rows = rows.withColumn("unrealised_pnl", F.when(F.col("_open"), F.col("_within")).otherwise(0.0)).withColumn("realised_pnl", F.when(F.col("_closing"), F.col("_within")).otherwise(0.0))
    return rows.withColumn("cumulative_realised_pnl", latched_sum(F.col("realised_pnl"), cum(keys))).drop("_open", "_closing", "_entry", "_trade", "_held", "_within")


def strategy_returns(rows: DataFrame, capital: float, pnl: str = "gross_pnl", equity: str = "portfolio_equity", result: str = "strategy_return", total: str = "cumulative_gross_pnl", first_zero: bool = True, keys: tuple = PAIR) -> DataFrame:
    """Cumulative P&L, equity and return on the equity before; null where that equity is not positive."""
    rows = rows.withColumn(total, latched_sum(F.col(pnl), cum(keys))).withColumn(equity, F.lit(capital) + F.col(total))
    before = F.lag(equity).over(by(keys))
    first = F.lit(0.0) if first_zero else F.col(pnl) / F.lit(capital)
    start = F.row_number().over(by(keys)) == 1
    return rows.withColumn(result, F.when(start, first).when(before > 0, F.col(pnl) / before))


def transaction_costs(rows: DataFrame, commission_bps: float = 0.0, slippage_bps: float = 0.0, fixed: float = 0.0, keys: tuple = PAIR) -> DataFrame:
    """Traded notional, commission, fixed fees and slippage by leg, and their sums; a leg that does not change costs nothing."""
    w = by(keys)
    for leg in "yx":
        rows = rows.withColumn(f"delta_units_{leg}", F.col(f"units_{leg}") - F.coalesce(F.lag(f"units_{leg}").over(w), F.lit(0.0)))
        still = F.col(f"delta_units_{leg}") == 0
        rows = rows.withColumn(f"traded_notional_{leg}", F.when(still, 0.0).otherwise(F.abs(f"delta_units_{leg}") * F.col(f"price_{leg}")))
        rows = rows.withColumn(f"commission_{leg}", F.col(f"traded_notional_{leg}") * F.lit(commission_bps / 1e4)).withColumn(f"slippage_{leg}", F.col(f"traded_notional_{leg}") * F.lit(slippage_bps / 1e4))
        rows = rows.withColumn(f"fixed_commission_{leg}", F.when(still, 0.0).otherwise(F.lit(fixed)))
    rows = rows.withColumn("commission_cost", F.col("commission_y") + F.col("commission_x") + F.col("fixed_commission_y") + F.col("fixed_commission_x"))
    rows = rows.withColumn("slippage_cost", F.col("slippage_y") + F.col("slippage_x")).withColumn("transaction_cost", F.col("commission_cost") + F.col("slippage_cost"))
    return rows.withColumn("cumulative_transaction_cost", latched_sum(F.col("transaction_cost"), cum(keys)))


def net_of_costs(rows: DataFrame, capital: float, keys: tuple = PAIR) -> DataFrame:
    rows = rows.withColumn("net_pnl", F.col("gross_pnl") - F.col("transaction_cost"))
    return strategy_returns(rows, capital, "net_pnl", "net_portfolio_equity", "net_strategy_return", "cumulative_net_pnl", False, keys)


def borrow_costs(rows: DataFrame, rate_y: float = 0.0, rate_x: float = 0.0, periods: int = 252, keys: tuple = PAIR) -> DataFrame:
    """Fee on the short market value of the row before; long legs pay nothing, a missing value gives null."""
    w = by(keys)
    for leg, rate in (("y", rate_y), ("x", rate_x)):
        value, units = F.lag(F.col(f"units_{leg}") * F.col(f"price_{leg}")).over(w), F.lag(f"units_{leg}").over(w)
        fee = F.greatest(-value, F.lit(0.0)) * F.lit(rate) / F.lit(periods)
        rows = rows.withColumn(f"borrow_cost_{leg}", F.when(F.coalesce(units, F.lit(0.0)) < 0, F.when(value.isNotNull(), fee)).otherwise(0.0))
    return rows.withColumn("borrow_cost", F.col("borrow_cost_y") + F.col("borrow_cost_x")).withColumn("cumulative_borrow_cost", latched_sum(F.col("borrow_cost"), cum(keys)))


def financing_costs(rows: DataFrame, rate: float = 0.0, periods: int = 252, keys: tuple = PAIR) -> DataFrame:
    """Charge on the gross exposure of the row before."""
    before = F.lag("gross_exposure").over(by(keys))
    start = F.row_number().over(by(keys)) == 1
    rows = rows.withColumn("financing_cost", F.when(start, 0.0).otherwise(before * F.lit(rate) / F.lit(periods)))
    return rows.withColumn("cumulative_financing_cost", latched_sum(F.col("financing_cost"), cum(keys)))


def gross_schedule(rows: DataFrame, capital: float, keys: tuple = PAIR) -> DataFrame:
    rows = split_pnl(position_pnl(rows, keys), keys)
    for leg in "yx":
        rows = rows.withColumn(f"market_value_{leg}", F.col(f"units_{leg}") * F.col(f"price_{leg}"))
    flat = F.col("executed_state") == "FLAT"
    long_ = F.greatest("notional_y", F.lit(0.0)) + F.greatest("notional_x", F.lit(0.0))
    short = F.greatest(-F.col("notional_y"), F.lit(0.0)) + F.greatest(-F.col("notional_x"), F.lit(0.0))
    known = flat | F.col("gross_exposure").isNotNull()
    rows = rows.withColumn("long_exposure", F.when(known, long_)).withColumn("short_exposure", F.when(known, short))
    return strategy_returns(rows, capital, keys=keys)


def net_schedule(rows: DataFrame, capital: float, commission_bps: float = 0.0, slippage_bps: float = 0.0, fixed: float = 0.0, keys: tuple = PAIR) -> DataFrame:
    return net_of_costs(transaction_costs(gross_schedule(rows, capital, keys), commission_bps, slippage_bps, fixed, keys), capital, keys)


def financed_schedule(rows: DataFrame, capital: float, commission_bps: float = 0.0, slippage_bps: float = 0.0, fixed: float = 0.0, borrow_y: float = 0.0, borrow_x: float = 0.0, financing: float = 0.0, periods: int = 252, keys: tuple = PAIR) -> DataFrame:
    """The whole schedule: gross, costs, carry = borrow + financing, and net after carry."""
    rows = net_schedule(rows, capital, commission_bps, slippage_bps, fixed, keys)
    rows = financing_costs(borrow_costs(rows, borrow_y, borrow_x, periods, keys), financing, periods, keys)
    rows = rows.withColumn("carry_cost", F.col("borrow_cost") + F.col("financing_cost"))
    rows = rows.withColumn("cumulative_carry_cost", latched_sum(F.col("carry_cost"), cum(keys))).withColumn("net_pnl_after_carry", F.col("net_pnl") - F.col("carry_cost"))
    return strategy_returns(rows, capital, "net_pnl_after_carry", "net_equity_after_carry", "net_return_after_carry", "cumulative_net_pnl_after_carry", False, keys)

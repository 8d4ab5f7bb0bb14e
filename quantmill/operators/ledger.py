"""Trade ledger: one row per completed trade of an accounting schedule, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.functions.windows import by, known_sum

PAIR = ("symbol_y", "symbol_x")
SUMS = ("gross_pnl", "commission_cost", "slippage_cost", "transaction_cost", "borrow_cost", "financing_cost", "carry_cost")
REASONS = {"EXIT_MEAN_REVERSION": "MEAN_REVERSION", "EXIT_STOP": "STOP", "EXIT_TIME": "TIME", "FORCED_EXIT": "END_OF_BACKTEST"}


def trade_rows(accounting: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Rows inside trades (those with a trade_id), with the units of the row before."""
    w = by(keys)
    rows = accounting.withColumn("_before_y", F.lag("units_y").over(w)).withColumn("_before_x", F.lag("units_x").over(w))
    return rows.filter("trade_id is not null")


def trade_windows(accounting: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Entry and exit row of each trade, closing row included; exit_row is null while a trade is open."""
    closing = F.when(F.col("executed_state") == "FLAT", F.col("pos"))
    return accounting.filter("trade_id is not null").groupBy(*keys, "trade_id").agg(F.min("pos").alias("entry_row"), F.max(closing).alias("exit_row"))


def ledger(accounting: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Endpoints, prices, units, reason, length, summed P&L and costs of completed trades; any unknown makes a sum null."""
    first = lambda c: F.min_by(c, "pos")
    last = lambda c: F.max_by(c, "pos")
    rows = trade_rows(accounting, keys)
    out = rows.groupBy(*keys, "trade_id").agg(
        first("executed_state").alias("side"), F.min("pos").alias("entry_row"), F.max("pos").alias("exit_row"), first("execution_event").alias("entry_event"), last("execution_event").alias("exit_event"),
        *[first(f"price_{x}").alias(f"entry_price_{x}") for x in "yx"], *[last(f"price_{x}").alias(f"exit_price_{x}") for x in "yx"],
        *[first(f"units_{x}").alias(f"entry_units_{x}") for x in "yx"], *[last(f"_before_{x}").alias(f"exit_units_{x}") for x in "yx"],
        first("hedge_ratio").alias("entry_hedge_ratio"), last("hedge_ratio").alias("exit_hedge_ratio"), last("executed_state").alias("_state"),
        *[known_sum(F.col(c)).alias(c) for c in SUMS],
    ).filter("_state = 'FLAT'").drop("_state")
    out = out.withColumn("exit_reason", F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("exit_event")))
    out = out.withColumn("holding_period_rows", F.col("exit_row") - F.col("entry_row"))
    out = out.withColumn("entry_gross_notional", F.abs(F.col("entry_units_y") * F.col("entry_price_y")) + F.abs(F.col("entry_units_x") * F.col("entry_price_x")))
    out = out.withColumn("total_cost", F.col("transaction_cost") + F.col("carry_cost")).withColumn("net_pnl", F.col("gross_pnl") - F.col("total_cost"))
    return out.withColumn("return_on_entry_gross_notional", F.col("net_pnl") / F.col("entry_gross_notional")).withColumn("forced_exit", F.col("exit_event") == "FORCED_EXIT")


def close_to(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """Whether two totals agree; null if one is unknown."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def reconcile(trades: DataFrame, accounting: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Per key: do the ledger's totals equal those of the schedule's completed trades?  With a status."""
    pairs = {"gross_pnl": "gross_pnl", "transaction_cost": "transaction_cost", "carry_cost": "carry_cost", "net_pnl": "net_pnl_after_carry"}
    booked = trades.groupBy(*keys).agg(F.count("*").alias("ledger_trades"), *[known_sum(F.col(c)).alias(f"ledger_{c}") for c in pairs])
    windows = trade_windows(accounting, keys)
    rows = accounting.join(windows.select(*keys, "trade_id", "exit_row"), [*keys, "trade_id"], "left")
    done, open_ = F.col("exit_row").isNotNull(), F.col("trade_id").isNotNull() & F.col("exit_row").isNull()
    total = lambda c, when: F.when(F.count_if(when & F.col(c).isNull()) == 0, F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0)))
    made = rows.groupBy(*keys).agg(
        F.count_distinct(F.when(done, F.col("trade_id"))).alias("completed_trade_count"), F.max(open_).alias("has_open_trade"),
        *[total(s, done).alias(f"schedule_{c}") for c, s in pairs.items()], *[total(s, open_).alias(f"open_trade_{c}") for c, s in pairs.items()],
        F.max_by("cumulative_net_pnl_after_carry", "pos").alias("final_cumulative"),
    )
    out = made.join(booked, list(keys), "left")
    for c in ("ledger_trades",):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in pairs:
        out = out.withColumn(f"ledger_{c}", F.when(F.col("ledger_trades") == 0, 0.0).otherwise(F.col(f"ledger_{c}"))).withColumn(f"{c}_match", close_to(F.col(f"ledger_{c}"), F.col(f"schedule_{c}")))
    out = out.withColumn("final_match", F.when(~F.col("has_open_trade"), close_to(F.col("ledger_net_pnl"), F.col("final_cumulative"))))
    matches = [F.col(f"{c}_match") for c in pairs]
    wrong = F.col("ledger_trades") != F.col("completed_trade_count")
    unknown = F.lit(False)
    for m in matches:
        wrong, unknown = wrong | F.coalesce(~m, F.lit(False)), unknown | m.isNull()
    wrong = wrong | F.coalesce(~F.col("final_match"), F.lit(False))
    status = F.when(wrong, "MISMATCH").when(unknown | (F.col("final_match").isNull() & ~F.col("has_open_trade")), "UNKNOWN_ACCOUNTING").when(F.col("has_open_trade"), "OPEN_TRADE").otherwise("RECONCILED")
    return out.withColumn("status", status)

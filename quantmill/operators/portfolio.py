"""Multi-pair portfolios on long tables: weights, static sleeves, exposures and concentration.

Sleeves compound on their own and are never refilled.  A null return, or one below -1, makes a sleeve unknown for
good; a return of exactly -1 empties it for good.  Both are decided by the first such row of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.windows import by, cum


def pair_inputs(rows: DataFrame) -> DataFrame:
    """pair_id as symbol_y|symbol_x and pair_key, which is the same for both orders of a pair."""
    key = F.concat_ws("|", F.least("symbol_y", "symbol_x"), F.greatest("symbol_y", "symbol_x"))
    return rows.withColumn("pair_id", F.concat_ws("|", "symbol_y", "symbol_x")).withColumn("pair_key", key)


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs that come in more than once."""
    return pair_inputs(pairs).groupBy("pair_key").agg(F.count("*").alias("n")).filter("n > 1")


def inferred_capital(accounting: DataFrame, keys: tuple) -> DataFrame:
    """Equity less cumulative P&L, and whether it is the same on all rows."""
    base = F.round(F.col("net_equity_after_carry") - F.col("cumulative_net_pnl_after_carry"), 6)
    return accounting.groupBy(*keys).agg(F.min(base).alias("capital"), (F.min(base) == F.max(base)).alias("constant"))


def allocate(pairs: DataFrame, capital: float, weight: str | None = None, normalize: bool = False) -> DataFrame:
    """weight and allocated_capital: equal weights, or those of a column, normalised if asked (the last id takes the rounding)."""
    whole = Window.partitionBy(F.lit(1))
    out = pairs.withColumn("weight", F.col(weight).cast("double") if weight else 1 / F.count("*").over(whole))
    if normalize:
        out = out.withColumn("_w", F.col("weight") / F.sum("weight").over(whole))
        rest = F.sum("_w").over(whole.orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("weight", F.when(F.lead("pair_id").over(whole.orderBy("pair_id")).isNull(), 1 - F.coalesce(rest, F.lit(0.0))).otherwise(F.col("_w"))).drop("_w")
    return out.withColumn("allocated_capital", F.col("weight") * F.lit(capital))


def invalid_allocations(allocations: DataFrame, capital: float) -> DataFrame:
    """Negative weights, weights that sum to more than 1, and capital that is not weight times the portfolio's."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    reason = F.when(F.col("weight") < 0, "negative").when(total > 1 + 1e-12, "above_one").when(F.abs(F.col("allocated_capital") - F.col("weight") * F.lit(capital)) > 1e-9 * F.lit(capital), "capital")
    return allocations.withColumn("reason", reason).filter("reason is not null")


def sleeves(returns: DataFrame, allocations: DataFrame, keys: tuple = ("pair_id",)) -> DataFrame:
    """prior_equity, sleeve_equity, sleeve_pnl and insolvent of each pair and row.  returns: keys, pos, r."""
    rows = returns.join(allocations.select(*keys, "weight", "allocated_capital"), list(keys))
    whole, r = Window.partitionBy(*keys), F.col("r")
    rows = rows.withColumn("_product", F.product(1 + F.coalesce(r, F.lit(0.0))).over(cum(keys)))
    bad = F.min(F.when(r.isNull() | (r < -1), F.col("pos"))).over(whole)
    dead = F.min(F.when((r == -1) | (F.col("_product") == 0), F.col("pos"))).over(whole)
    rows = rows.withColumn("_bad", bad).withColumn("_dead", dead)
    broken = F.coalesce((F.col("_bad") <= F.col("pos")) & ~F.coalesce(F.col("_dead") < F.col("_bad"), F.lit(False)), F.lit(False))
    empty = F.coalesce((F.col("_dead") <= F.col("pos")) & ~F.coalesce(F.col("_bad") < F.col("_dead"), F.lit(False)), F.lit(False))
    none = F.col("weight") == 0
    equity = F.when(none | empty, 0.0).when(~broken, F.col("allocated_capital") * F.col("_product"))
    rows = rows.withColumn("insolvent", empty & ~none).withColumn("sleeve_equity", equity)
    start = F.row_number().over(by(keys)) == 1
    rows = rows.withColumn("prior_equity", F.when(start, F.col("allocated_capital")).otherwise(F.lag("sleeve_equity").over(by(keys))))
    return rows.withColumn("sleeve_pnl", F.col("sleeve_equity") - F.col("prior_equity")).drop("_product", "_bad", "_dead")


def portfolio_returns(sleeve_rows: DataFrame, allocations: DataFrame, capital: float) -> DataFrame:
    """P&L, equity and return of the portfolio by ``pos``; unknown from the first row on which a sleeve is unknown."""
    held = F.col("weight") > 0
    cash = allocations.agg(F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("cash_weight"))
    rows = sleeve_rows.groupBy("pos").agg(
        F.count_if(held & F.col("sleeve_equity").isNull()).alias("unavailable"), F.count_if(held & (F.col("r") < -1)).alias("invalid"), F.count_if("insolvent").alias("insolvent_sleeves"),
        F.sum("sleeve_pnl").alias("_pnl"), F.sum("sleeve_equity").alias("_equity"),
    ).crossJoin(F.broadcast(cash))  # one row of cash weight
    upto = Window.partitionBy(F.lit(1)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = F.max("unavailable").over(upto) == 0
    rows = rows.withColumn("portfolio_pnl", F.when(known, F.col("_pnl"))).withColumn("portfolio_equity", F.when(known, F.lit(capital) * F.col("cash_weight") + F.col("_equity")))
    before = F.coalesce(F.lag("portfolio_equity").over(Window.partitionBy(F.lit(1)).orderBy("pos")), F.when(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")) == 1, F.lit(capital)))
    rows = rows.withColumn("portfolio_return", F.when(before > 0, F.col("portfolio_pnl") / before)).withColumn("catastrophic", F.coalesce(F.max((F.col("portfolio_equity") == 0).cast("int")).over(upto) == 1, F.lit(False)))
    reason = F.when(F.col("invalid") > 0, "invalid_return").when(F.col("unavailable") > 0, "unavailable").when(F.col("catastrophic"), "exhausted")
    return rows.withColumn("reason", reason).drop("_pnl", "_equity")


def symbol_exposures(exposures: DataFrame) -> DataFrame:
    """Net and unnetted gross value per symbol and row, over all pairs that hold it, and how many do."""
    legs = exposures.select("pos", "pair_id", F.explode(F.array(F.struct(F.col("symbol_y").alias("symbol"), F.col("market_value_y").alias("v")), F.struct(F.col("symbol_x").alias("symbol"), F.col("market_value_x").alias("v")))).alias("x"))
    legs = legs.select("pos", "pair_id", "x.symbol", "x.v")
    return legs.groupBy("pos", "symbol").agg(F.sum("v").alias("net"), F.sum(F.abs("v")).alias("unnetted_gross"), F.count_distinct("pair_id").alias("pairs"))


def aggregate_exposures(exposures: DataFrame) -> DataFrame:
    """Totals by row over pairs, all null unless every pair's values are known, with the consolidated gross by symbol."""
    y, x = F.col("market_value_y"), F.col("market_value_x")
    known = F.count_if(y.isNull() | x.isNull()) == 0
    up = lambda c: F.greatest(c, F.lit(0.0))
    totals = exposures.groupBy("pos").agg(
        F.when(known, F.sum(F.abs(y) + F.abs(x))).alias("total_gross"), F.when(known, F.sum(y + x)).alias("total_net"), F.when(known, F.sum(up(y) + up(x))).alias("total_long"),
        F.when(known, F.sum(up(-y) + up(-x))).alias("total_short"), known.alias("exposure_available"), F.count_if((y != 0) | (x != 0)).alias("active_pair_count"),
    )
    symbols = symbol_exposures(exposures).groupBy("pos").agg(F.sum(F.abs("net")).alias("consolidated_gross"), F.max("unnetted_gross").alias("largest_symbol_gross"), F.count_if(F.col("pairs") > 1).alias("shared_symbols"))
    return totals.join(symbols, "pos")


def portfolio_schedule(returns: DataFrame, exposures: DataFrame, max_ratio: float | None = None) -> DataFrame:
    """Returns and exposures by row, leverage, and whether it is over a limit."""
    out = returns.join(exposures, "pos", "left").withColumn("gross_exposure_ratio", F.when(F.col("portfolio_equity") > 0, F.col("total_gross") / F.col("portfolio_equity")))
    limit = F.lit(max_ratio).cast("double")
    status = F.when(limit.isNull(), "NOT_CONFIGURED").when(F.col("gross_exposure_ratio").isNull(), "UNEVALUABLE").when(F.col("gross_exposure_ratio") > limit + 1e-12, "BREACH").otherwise("WITHIN_LIMIT")
    return out.withColumn("leverage_status", status)


def concentration(allocations: DataFrame) -> DataFrame:
    """Herfindahl indexes with and without cash, effective number of pairs, counts."""
    w, squares = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    out = allocations.agg(F.count("*").alias("pairs"), F.count_if(F.col("weight") > 0).alias("funded_pairs"), w.alias("invested_weight"), squares.alias("_s"))
    cash = F.greatest(F.lit(0.0), 1 - F.col("invested_weight"))
    out = out.withColumn("cash_weight", cash).withColumn("hhi", F.when(F.col("invested_weight") > 0, F.col("_s") / (F.col("invested_weight") * F.col("invested_weight"))))
    return out.withColumn("effective_pairs", 1 / F.col("hhi")).withColumn("whole_hhi", F.col("_s") + F.col("cash_weight") * F.col("cash_weight")).drop("_s")

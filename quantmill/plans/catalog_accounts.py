"""Registered queries: accounting, trade ledger, performance figures and the rules that check them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantmill.operators import accounting, ledger, metrics, positions, quality, signals
from quantmill.plans import panels
from quantmill.plans.catalog_core import FOLDS, RULES, brand_folds, screening_batch
from quantmill.plans.panels import CAPITAL, COSTS, PAIR, UPTO, W, accounts, brand_prices, returns, schedule
from quantmill.registry import register

KEYS = "symbol_y symbol_x"


# --- accounting ------------------------------------------------------------------------------------------------------
@register("A01_position_pnl", f"{KEYS} pos:i pnl_y:4 pnl_x:4 gross_pnl:4", "SELECT * FROM pl")
def a01(spark, sf):
    return accounting.position_pnl(schedule(spark, sf))


@register("A02_latched_sum", f"{KEYS} pos:i total:4", f"SELECT symbol_y, symbol_x, pos, CASE WHEN max(CASE WHEN pos = 400 THEN 1 ELSE 0 END) OVER u = 0 THEN sum(gross_pnl) OVER u END AS total FROM pl WINDOW u AS ({UPTO})")
def a02(spark, sf):
    from quantmill.functions.windows import cum, latched_sum

    rows = accounting.position_pnl(schedule(spark, sf)).withColumn("g", F.when(F.col("pos") != 400, F.col("gross_pnl")))
    return rows.withColumn("total", latched_sum(F.col("g"), cum(PAIR)))


SPLIT = f"""SELECT *, CASE WHEN executed_state <> 'FLAT' THEN w ELSE 0.0 END AS unrealised_pnl, CASE WHEN executed_state = 'FLAT' AND trade_id IS NOT NULL THEN w ELSE 0.0 END AS realised_pnl
  FROM (SELECT *, sum(CASE WHEN prev_state = 'FLAT' THEN 0.0 ELSE gross_pnl END) OVER (PARTITION BY symbol_y, symbol_x, trade_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM co)"""


@register("A03_split_pnl", f"{KEYS} pos:i trade_id:i realised_pnl:4 unrealised_pnl:4 cumulative_realised_pnl:4", f"SELECT *, sum(realised_pnl) OVER ({UPTO}) AS cumulative_realised_pnl FROM ({SPLIT})")
def a03(spark, sf):
    return accounting.split_pnl(accounting.position_pnl(schedule(spark, sf)))


@register("A04_strategy_returns", f"{KEYS} pos:i portfolio_equity:4 strategy_return:9", "SELECT * FROM ac")
def a04(spark, sf):
    return accounting.strategy_returns(accounting.position_pnl(schedule(spark, sf)), CAPITAL)


@register("A05_transaction_costs", f"{KEYS} pos:i traded_notional_y:4 commission_cost:4 slippage_cost:4 transaction_cost:4 cumulative_transaction_cost:4", "SELECT * FROM ac")
def a05(spark, sf):
    return accounting.transaction_costs(schedule(spark, sf), 5.0, 2.0, 1.0)


@register("A06_net_of_costs", f"{KEYS} pos:i net_pnl:4 cumulative_net_pnl:4 net_portfolio_equity:4 net_strategy_return:9", "SELECT * FROM ac")
def a06(spark, sf):
    return accounting.net_schedule(schedule(spark, sf), CAPITAL, 5.0, 2.0, 1.0)


@register("A07_borrow_costs", f"{KEYS} pos:i borrow_cost_y:6 borrow_cost_x:6 borrow_cost:6 cumulative_borrow_cost:5", "SELECT * FROM ac")
def a07(spark, sf):
    return accounting.borrow_costs(schedule(spark, sf), 0.02, 0.03)


@register("A08_financing_costs", f"{KEYS} pos:i financing_cost:6 cumulative_financing_cost:5", "SELECT * FROM ac")
def a08(spark, sf):
    return accounting.financing_costs(schedule(spark, sf), 0.01)


@register("A09_gross_schedule", f"{KEYS} pos:i market_value_y:4 long_exposure:4 short_exposure:4 gross_pnl:4 cumulative_gross_pnl:4 portfolio_equity:4", "SELECT *, notional_y AS market_value_y, greatest(notional_y, 0) + greatest(notional_x, 0) AS long_exposure, greatest(-notional_y, 0) + greatest(-notional_x, 0) AS short_exposure FROM ac")
def a09(spark, sf):
    return accounting.gross_schedule(schedule(spark, sf), CAPITAL)


@register("A10_net_schedule", f"{KEYS} pos:i delta_units_y:6 delta_units_x:6 transaction_cost:4 net_pnl:4 net_strategy_return:9", "SELECT * FROM ac")
def a10(spark, sf):
    return accounting.net_schedule(schedule(spark, sf), CAPITAL, 5.0, 2.0, 1.0)


@register("A11_financed_schedule", f"{KEYS} pos:i carry_cost:6 cumulative_carry_cost:5 net_pnl_after_carry:4 cumulative_net_pnl_after_carry:4 net_equity_after_carry:4 net_return_after_carry:9", "SELECT * FROM ac")
def a11(spark, sf):
    return accounts(spark, sf)


def filled_accounts(spark, sf):
    rows = panels.signal_table(spark, sf).withColumn("observed_y", F.dayofmonth("date") % 4 != 0).withColumn("observed_x", F.lit(True))
    ready = rows.withColumn("zscore", F.col("z")).withColumn("tradable", F.col("observed_y") & F.col("observed_x")).withColumn("sized", F.col("hedge_ratio") > 0)
    fills = signals.filled_signals(ready, RULES, 1, True).select(*PAIR, "pos", "executed_state", "execution_event")
    placed = positions.position_schedule(rows.drop("state", "event").join(fills, [*PAIR, "pos"]), panels.TARGET)
    return accounting.financed_schedule(positions.force_close(placed), CAPITAL, **COSTS)


@register("A12_pair_evaluation", f"{KEYS} pos:i executed_state execution_event net_pnl_after_carry:4 net_equity_after_carry:4")
def a12(spark, sf):
    return filled_accounts(spark, sf)


# --- ledger ----------------------------------------------------------------------------------------------------------
@register("L01_trade_windows", f"{KEYS} trade_id:i entry_row:i exit_row:i", "SELECT symbol_y, symbol_x, trade_id, min(pos) AS entry_row, max(CASE WHEN executed_state = 'FLAT' THEN pos END) AS exit_row FROM ac WHERE trade_id IS NOT NULL GROUP BY 1, 2, 3")
def l01(spark, sf):
    return ledger.trade_windows(accounts(spark, sf))


@register("L02_trade_ledger", f"{KEYS} trade_id:i side entry_row:i exit_row:i entry_event exit_event entry_price_y:9 exit_price_x:9 entry_units_y:6 exit_units_x:6 holding_period_rows:i gross_pnl:4 transaction_cost:4 carry_cost:5 net_pnl:4", "SELECT * FROM td")
def l02(spark, sf):
    return ledger.ledger(accounts(spark, sf))


@register("L03_reconciliation", f"{KEYS} completed_trade_count:i ledger_net_pnl:4 schedule_net_pnl:4 status", "SELECT symbol_y, symbol_x, count(td.trade_id) AS completed_trade_count, coalesce(sum(td.net_pnl), 0.0) AS ledger_net_pnl, coalesce(sum(td.net_pnl), 0.0) AS schedule_net_pnl, 'RECONCILED' AS status FROM (SELECT DISTINCT symbol_y, symbol_x FROM ac) LEFT JOIN td USING (symbol_y, symbol_x) GROUP BY 1, 2")
def l03(spark, sf):
    rows = accounts(spark, sf)
    return ledger.reconcile(ledger.ledger(rows), rows)


# --- performance -----------------------------------------------------------------------------------------------------
CORE = """SELECT symbol_y, symbol_x, count(*) AS observations, exp(sum(ln(1 + r))) - 1 AS total_return, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS annualized_return, stddev_samp(r) * sqrt(252) AS annualized_volatility,
  CASE WHEN stddev_samp(r) > 1e-12 * greatest(1.0, max(abs(r))) THEN (avg(r) - f) / stddev_samp(r) * sqrt(252) END AS sharpe_ratio, sqrt(avg(pow(least(r - f, 0), 2))) * sqrt(252) AS downside_deviation, CASE WHEN sqrt(avg(pow(least(r - f, 0), 2))) > 1e-12 * greatest(1.0, max(abs(r))) THEN (avg(r) - f) / sqrt(avg(pow(least(r - f, 0), 2))) * sqrt(252) END AS sortino_ratio
  FROM rt, (SELECT exp(ln(1.02) / 252) - 1 AS f) GROUP BY 1, 2, f"""
CORE_COLUMNS = {
    "P01_total_return": "total_return:9", "P02_annualized_return": "annualized_return:9", "P03_annualized_volatility": "annualized_volatility:9", "P05_sharpe_ratio": "sharpe_ratio:6",
    "P06_downside_deviation": "downside_deviation:9", "P07_sortino_ratio": "sortino_ratio:6", "P08_core_metrics": "observations:i total_return:9 annualized_return:9 annualized_volatility:9 sharpe_ratio:6 downside_deviation:9 sortino_ratio:6",
}


def core(spark, sf):
    return metrics.core_metrics(returns(spark, sf), rate=0.02)


for _name, _columns in CORE_COLUMNS.items():
    register(_name, f"{KEYS} {_columns}", CORE)(core)


@register("P04_risk_free", "rate:6 per_period:12", "SELECT r AS rate, exp(ln(1 + r) / 252) - 1 AS per_period FROM (SELECT DISTINCT round(l_discount, 2) AS r FROM lineitem)")
def p04(spark, sf):
    rows = panels.table(spark, sf, "lineitem").select(F.round("l_discount", 2).alias("rate")).distinct()
    return rows.withColumn("per_period", F.expm1(F.log1p("rate") / 252))


@register("P09_equity_curve", f"{KEYS} pos:i equity:9", "SELECT * FROM eq")
def p09(spark, sf):
    return metrics.equity_and_drawdown(returns(spark, sf))


@register("P10_drawdown", f"{KEYS} pos:i drawdown:9", "SELECT * FROM eq")
def p10(spark, sf):
    return p09(spark, sf)


EPISODES = f"""SELECT symbol_y, symbol_x, top AS peak_pos, min(pos) AS start_pos, (min({{'a': round(drawdown, 12), 'b': pos}})).b AS trough_pos, any_value(nxt) AS recovery_pos, min(drawdown) AS maximum_drawdown, coalesce(any_value(nxt), any_value(last)) - coalesce(top, -1) AS duration, any_value(nxt) IS NOT NULL AS recovered
  FROM (SELECT *, max(CASE WHEN equity >= peak * (1 - 1e-12) THEN pos END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, min(CASE WHEN equity >= peak * (1 - 1e-12) THEN pos END) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(pos) OVER (PARTITION BY symbol_y, symbol_x) AS last FROM eq)
  WHERE equity < peak * (1 - 1e-12) GROUP BY symbol_y, symbol_x, top"""


@register("P11_drawdown_episodes", f"{KEYS} peak_pos:i start_pos:i trough_pos:i recovery_pos:i maximum_drawdown:9 duration:i recovered", EPISODES)
def p11(spark, sf):
    return metrics.drawdown_episodes(returns(spark, sf))


DRAWDOWNS = f"""SELECT c.*, e.trough_pos AS maximum_drawdown_trough, coalesce(e.longest, 0) AS longest_drawdown_duration, CASE WHEN -c.maximum_drawdown > 1e-12 THEN a.annualized_return / -c.maximum_drawdown END AS calmar_ratio FROM
  (SELECT symbol_y, symbol_x, count(*) AS observations, least(min(drawdown), 0.0) AS maximum_drawdown, arg_max(drawdown, pos) AS current_drawdown, count(*) FILTER (drawdown < -1e-12) AS underwater_observations FROM eq GROUP BY 1, 2) c
  JOIN (SELECT symbol_y, symbol_x, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS annualized_return FROM rt GROUP BY 1, 2) a USING (symbol_y, symbol_x)
  LEFT JOIN (SELECT symbol_y, symbol_x, arg_min(trough_pos, maximum_drawdown) AS trough_pos, max(duration) AS longest FROM ({EPISODES}) GROUP BY 1, 2) e USING (symbol_y, symbol_x)"""


def drawdowns(spark, sf):
    return metrics.drawdown_metrics(returns(spark, sf))


for _name, _columns in {"P12_maximum_drawdown": "maximum_drawdown:9", "P13_longest_drawdown": "longest_drawdown_duration:i", "P14_calmar_ratio": "calmar_ratio:6", "P15_drawdown_metrics": "observations:i maximum_drawdown:9 maximum_drawdown_trough:i longest_drawdown_duration:i calmar_ratio:6 current_drawdown:9 underwater_observations:i"}.items():
    register(_name, f"{KEYS} {_columns}", DRAWDOWNS)(drawdowns)


CLASSES = "SELECT *, CASE WHEN abs(net_pnl) <= 1e-12 * greatest(1.0, max(abs(net_pnl)) OVER (PARTITION BY symbol_y, symbol_x)) THEN 'breakeven' WHEN net_pnl > 0 THEN 'winner' ELSE 'loser' END AS class FROM td"
TRADES = f"""SELECT symbol_y, symbol_x, count(*) AS trades, count(*) FILTER (class = 'winner') / count(*) AS win_rate, avg(net_pnl) FILTER (class = 'winner') AS average_winner, avg(net_pnl) FILTER (class = 'loser') AS average_loser, avg(net_pnl) AS expectancy,
  avg(net_pnl) FILTER (class = 'winner') / -avg(net_pnl) FILTER (class = 'loser') AS payoff_ratio, coalesce(sum(net_pnl) FILTER (class = 'winner'), 0) / -sum(net_pnl) FILTER (class = 'loser') AS profit_factor,
  avg(holding_period_rows) AS average_holding, median(holding_period_rows) AS median_holding, sum(net_pnl) AS total_net_pnl FROM ({CLASSES}) GROUP BY 1, 2"""


@register("P16_trade_classes", f"{KEYS} trade_id:i class", CLASSES)
def p16(spark, sf):
    return metrics.classified_trades(l02(spark, sf))


def trades(spark, sf):
    return metrics.trade_metrics(l02(spark, sf))


for _name, _columns in {"P17_win_rate": "win_rate:9", "P18_average_trades": "average_winner:4 average_loser:4", "P19_payoff_ratio": "payoff_ratio:6", "P20_expectancy": "expectancy:4", "P21_profit_factor": "profit_factor:6", "P22_holding_periods": "average_holding:6 median_holding:6", "P24_trade_metrics": "trades:i win_rate:9 expectancy:4 profit_factor:6 total_net_pnl:4"}.items():
    register(_name, f"{KEYS} {_columns}", TRADES)(trades)


@register("P23_turnover", f"{KEYS} turnover:9", f"SELECT symbol_y, symbol_x, sum(traded_notional_y + traded_notional_x) / {CAPITAL} AS turnover FROM ac GROUP BY 1, 2")
def p23(spark, sf):
    return metrics.turnover(accounts(spark, sf), CAPITAL)


ROLLING = f"""SELECT *, CASE WHEN c = 63 THEN s * sqrt(252) END AS rolling_volatility, CASE WHEN c = 63 AND s > 1e-12 THEN m / s * sqrt(252) END AS rolling_sharpe, CASE WHEN c = 63 AND d > 1e-12 THEN m / d * sqrt(252) END AS rolling_sortino
  FROM (SELECT *, count(r) OVER w AS c, stddev_samp(r) OVER w AS s, avg(r) OVER w AS m, sqrt(avg(pow(least(r, 0), 2)) OVER w) AS d FROM rt WINDOW w AS ({W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""


def rolling(spark, sf):
    return metrics.rolling_metrics(returns(spark, sf), 63)


for _name, _column in {"P25_rolling_volatility": "rolling_volatility:7", "P26_rolling_sharpe": "rolling_sharpe:4", "P27_rolling_sortino": "rolling_sortino:4"}.items():
    register(_name, f"{KEYS} pos:i {_column}", ROLLING)(rolling)


@register("P28_rolling_drawdown", f"{KEYS} pos:i drawdown:9", f"SELECT symbol_y, symbol_x, pos, CASE WHEN pos % 50 <> 7 THEN e / greatest(max(e) OVER ({UPTO}), 1.0) - 1 END AS drawdown FROM (SELECT *, product(CASE WHEN pos % 50 = 7 THEN 1.0 ELSE 1 + r END) OVER ({UPTO}) AS e FROM rt)")
def p28(spark, sf):
    return metrics.rolling_drawdown(returns(spark, sf).withColumn("r", F.when(F.col("pos") % 50 != 7, F.col("r"))))


BENCH = """SELECT symbol_y, symbol_x, count(*) AS observations, CASE WHEN var_samp(b) > 1e-12 * greatest(1.0, max(b * b)) THEN covar_samp(r, b) / var_samp(b) END AS beta, ((avg(r) - 0.0) - CASE WHEN var_samp(b) > 1e-12 * greatest(1.0, max(b * b)) THEN covar_samp(r, b) / var_samp(b) END * (avg(b) - 0.0)) * 252 AS alpha, stddev_samp(r - b) * sqrt(252) AS tracking_error,
  CASE WHEN stddev_samp(r - b) > 1e-12 * greatest(1.0, max(abs(r - b))) THEN avg(r - b) / stddev_samp(r - b) * sqrt(252) END AS information_ratio, CASE WHEN stddev_samp(r) > 1e-12 * greatest(1.0, max(abs(r))) AND stddev_samp(b) > 1e-12 * greatest(1.0, max(abs(b))) THEN corr(r, b) END AS correlation FROM (SELECT a.*, b.b FROM rt a JOIN (SELECT date, avg(r) AS b FROM rt GROUP BY 1) b USING (date)) GROUP BY 1, 2"""


def against_benchmark(spark, sf):
    rows = returns(spark, sf)
    return metrics.benchmark_metrics(rows.join(rows.groupBy("date").agg(F.avg("r").alias("b")), "date"))


for _name, _columns in {"P29_beta": "beta:5", "P30_alpha": "alpha:6", "P31_tracking_error": "tracking_error:8", "P32_information_ratio": "information_ratio:5", "P33_correlation": "correlation:6", "P34_benchmark_metrics": "observations:i beta:5 alpha:6 tracking_error:8 correlation:6"}.items():
    register(_name, f"{KEYS} {_columns}", BENCH)(against_benchmark)


@register("P35_performance_report", f"{KEYS} total_return:9 maximum_drawdown:9 win_rate:9 total_net_pnl:4 beta:5 tracking_error:8 turnover:9", f"SELECT c.symbol_y, c.symbol_x, c.total_return, d.maximum_drawdown, t.win_rate, t.total_net_pnl, b.beta, b.tracking_error, u.turnover FROM ({CORE}) c JOIN ({DRAWDOWNS}) d USING (symbol_y, symbol_x) JOIN ({BENCH}) b USING (symbol_y, symbol_x) JOIN (SELECT symbol_y, symbol_x, sum(traded_notional_y + traded_notional_x) / {CAPITAL} AS turnover FROM ac GROUP BY 1, 2) u USING (symbol_y, symbol_x) LEFT JOIN ({TRADES}) t USING (symbol_y, symbol_x)")
def p35(spark, sf):
    rows = accounts(spark, sf)
    made = rows.select(*PAIR, "pos", "date", F.col("net_return_after_carry").alias("r"))
    return metrics.performance_report(made, ledger.ledger(rows), rate=0.02, benchmark=made.groupBy("date").agg(F.avg("r").alias("b")), accounting=rows, capital=CAPITAL)


# --- rules -----------------------------------------------------------------------------------------------------------
@register("Q01_accounting_identities", f"{KEYS} pos:i rule", "SELECT symbol_y, symbol_x, pos, 'cost_is_parts' AS rule FROM pp WHERE pos % 100 = 17")
def q01(spark, sf):
    rows = accounts(spark, sf)
    return quality.accounting_violations(rows.withColumn("transaction_cost", F.when(F.col("pos") % 100 == 17, F.col("transaction_cost") + 1).otherwise(F.col("transaction_cost"))), CAPITAL).filter("rule <> 'net_is_rest'")


@register("Q02_falling_costs", f"{KEYS} pos:i", "SELECT symbol_y, symbol_x, pos FROM pp WHERE pos = 300")
def q02(spark, sf):
    rows = accounts(spark, sf)
    return quality.falling_costs(rows.withColumn("cumulative_transaction_cost", F.when(F.col("pos") >= 300, F.col("cumulative_transaction_cost") - 1e6).otherwise(F.col("cumulative_transaction_cost"))), "cumulative_transaction_cost")


@register("Q03_ledger_rebuilt", f"{KEYS} trade_id:i reason", "SELECT symbol_y, symbol_x, trade_id, CASE WHEN trade_id % 10 = 0 THEN 'missing' ELSE 'differs' END AS reason FROM td WHERE trade_id % 10 IN (0, 3)")
def q03(spark, sf):
    good = l02(spark, sf)
    bad = good.filter("trade_id % 10 <> 0").withColumn("net_pnl", F.when(F.col("trade_id") % 10 == 3, F.col("net_pnl") + 1).otherwise(F.col("net_pnl")))
    return quality.table_differences(bad, good, [*PAIR, "trade_id"], ["side", "net_pnl", "holding_period_rows"])


@register("Q04_execution_rules", f"{KEYS} pos:i rule", "SELECT symbol_y, symbol_x, pos, 'unobserved' AS rule FROM ps WHERE execution_event NOT IN ('NONE', 'FORCED_EXIT') AND pos % 3 = 0")
def q04(spark, sf):
    return quality.execution_violations(schedule(spark, sf).withColumn("observed_x", F.col("pos") % 3 != 0))


@register("Q05_screening_rules", "run_id rule", "SELECT DISTINCT 'run-a' AS run_id, 'not_canonical' AS rule FROM pp WHERE date < DATE '1998-06-01'")
def q05(spark, sf):
    rows, bad = screening_batch(spark, sf), F.col("run_id") == "run-a"
    y, x = F.col("symbol_y"), F.col("symbol_x")
    swapped = rows.withColumns({"symbol_y": F.when(bad, x).otherwise(y), "symbol_x": F.when(bad, y).otherwise(x)})
    return quality.screening_violations(swapped)


@register("Q06_unique_keys", "l_orderkey:i l_linenumber:i n:i", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q06(spark, sf):
    return quality.repeated_keys(panels.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


RANKED = """SELECT *, CAST(substr(symbol_y, 7) AS INT) % 3 = 0 AS swapped, CAST(row_number() OVER (PARTITION BY group_name ORDER BY symbol_y, symbol_x) AS BIGINT) AS k FROM pairs"""


@register("Q06_screening_checks", f"{KEYS} rule", f"""SELECT CASE WHEN swapped THEN symbol_x ELSE symbol_y END AS symbol_y, CASE WHEN swapped THEN symbol_y ELSE symbol_x END AS symbol_x, rule FROM ({RANKED}) JOIN (VALUES ('canonical'), ('rank'), ('half_life'), ('observations')) v(rule)
  ON (rule = 'canonical' AND swapped) OR (rule = 'rank' AND k IN (3, 5)) OR (rule = 'half_life' AND k = 7) OR (rule = 'observations' AND k = 2)""")
def q06b(spark, sf):
    """Planted: swapped pairs, a selected pair ranked 0, a rejected one with a rank, a half-life with its flag, a negative count."""
    k, y, x = F.col("k"), F.col("symbol_y"), F.col("symbol_x")
    rows = panels.brand_pairs(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("group_name").orderBy("symbol_y", "symbol_x")))
    swapped = panels.number("symbol_y") % 3 == 0
    rows = rows.select(F.when(swapped, x).otherwise(y).alias("symbol_y"), F.when(swapped, y).otherwise(x).alias("symbol_x"), "k", (k <= 4).alias("selected"), F.when(k == 3, 0).when(k <= 5, k).alias("rank"))
    rows = rows.withColumn("observations", F.when(k == 2, -1).otherwise(504)).withColumn("half_life_was_infinite", k >= 6).withColumn("half_life", F.when((k < 6) | (k == 7), 5.0))
    return quality.check_violations(rows, quality.screening_checks(), ["symbol_y", "symbol_x"])


MONTHS = """SELECT strftime(o_orderdate, '%Y-%m') AS run_id, month(o_orderdate) AS m FROM orders GROUP BY 1, 2"""


@register("Q06_run_summary_checks", "run_id rule", f"SELECT run_id, CASE m WHEN 1 THEN 'pair_shape' WHEN 2 THEN 'screening' WHEN 3 THEN 'stages' WHEN 4 THEN 'folds' ELSE 'scenarios' END AS rule FROM ({MONTHS}) WHERE m <= 5")
def q06c(spark, sf):
    """Runs are months of orders, counted by status; each of the first five months of a year breaks another rule."""
    month, status = F.month("o_orderdate"), lambda s: F.count_if(F.col("o_orderstatus") == s)
    rows = panels.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), month.alias("m")).agg(F.count("*").alias("n"), status("F").alias("f"), status("O").alias("o"))
    m, rest = F.col("m"), F.col("n") - F.col("f") - F.col("o")
    rows = rows.withColumns({
        "selected_pair": F.lit("A|B"), "symbol_y": F.when(m != 1, "A"), "symbol_x": F.lit("B"), "selected_rank": F.lit(1), "candidates": F.col("n"), "selected": F.when(m == 2, F.col("n") + 1).otherwise(F.col("f")),
        "walk_forward_stage": F.when(m == 3, "FINISHED").otherwise("COMPLETED"), "grid_stage": F.when(m == 6, "NOT_REQUESTED").otherwise("COMPLETED"), "folds": F.when(m == 4, F.col("n") + 1).otherwise(F.col("n")),
        "completed_folds": F.col("f"), "no_selection_folds": F.col("o"), "insufficient_folds": rest, "scenarios": F.when(m.isin(5, 6), F.col("n") + 1).otherwise(F.col("n")), "completed_scenarios": F.col("f"), "invalid_scenarios": F.col("o"), "failed_scenarios": rest,
    })
    return quality.check_violations(rows, quality.run_summary_checks(), ["run_id"])


@register("Q10_digests", "symbol reason", "SELECT DISTINCT symbol, 'differs' AS reason FROM px WHERE CAST(substr(symbol, 7) AS INT) % 6 = 1")
def q10_digests(spark, sf):
    """Stored digests against recomputed ones, after a cell of some symbols has changed."""
    rows = brand_prices(spark, sf).withColumn("cents", F.round(F.col("price") * 100).cast("long"))
    first = F.col("date") == F.min("date").over(Window.partitionBy("symbol"))
    changed = rows.withColumn("cents", F.when(first & (panels.number("symbol") % 6 == 1), F.col("cents") + 1).otherwise(F.col("cents")))
    digest = lambda x: quality.content_digest(x, ["symbol", "date", "cents"], "symbol")
    return quality.table_differences(digest(changed), digest(rows), ["symbol"], ["digest"])


@register("Q11_content_digests", "symbol digest", """SELECT symbol, sha256(string_agg(leaf || '=' || d, ',' ORDER BY leaf)) AS digest FROM (SELECT symbol, substr(d, 1, 4) AS leaf, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS d FROM (
  SELECT symbol, sha256('{"cents":' || c || ',"date":"' || strftime(date, '%Y-%m-%d') || '","symbol":"' || symbol || '"}') AS d, count(*) AS n FROM (SELECT symbol, date, CAST(round(price * 100) AS BIGINT) AS c FROM px) GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""")
def q11(spark, sf):
    return quality.content_digest(brand_prices(spark, sf).withColumn("cents", F.round(F.col("price") * 100).cast("long")), ["symbol", "date", "cents"], "symbol")


@register("Q12_signal_contract", f"{KEYS} pos:i rule", "SELECT symbol_y, symbol_x, pos, CASE WHEN event LIKE 'ENTER%' THEN 'none_changes' ELSE 'none_changes' END AS rule FROM se WHERE event <> 'NONE' AND pos % 5 = 0")
def q12(spark, sf):
    rows = panels.signal_table(spark, sf)
    return quality.signal_violations(rows.withColumn("event", F.when(F.col("pos") % 5 == 0, "NONE").otherwise(F.col("event"))))


@register("Q13_panel_contract", "symbol date rule", "SELECT symbol, date, CASE WHEN day(date) = 2 THEN 'repeated' ELSE 'not_positive' END AS rule FROM px, range(0, CASE WHEN day(date) = 2 THEN 2 ELSE 1 END) WHERE day(date) IN (1, 2)".replace("FROM px, range(0, CASE WHEN day(date) = 2 THEN 2 ELSE 1 END) WHERE day(date) IN (1, 2)", "FROM px JOIN (VALUES (1), (2)) v(k) ON k = 1 OR day(date) = 2 WHERE day(date) IN (1, 2)"))
def q13(spark, sf):
    rows = brand_prices(spark, sf)
    rows = rows.withColumn("price", F.when(F.dayofmonth("date") == 1, -F.col("price")).otherwise(F.col("price")))
    return quality.panel_violations(rows.union(rows.filter(F.dayofmonth("date") == 2)))


@register("Q13_fold_contract", "fold_id:i rule", f"SELECT fold_id, 'gap' AS rule FROM ({FOLDS}) WHERE fold_id % 4 = 1")
def q13b(spark, sf):
    folds = brand_folds(spark, sf)
    n = brand_prices(spark, sf).select("date").distinct().count()
    return quality.fold_violations(folds.withColumn("trading_start_pos", F.when(F.col("fold_id") % 4 == 1, F.col("trading_start_pos") + 1).otherwise(F.col("trading_start_pos"))), n)


@register("Q14_ledger_contract", f"{KEYS} trade_id:i rule", "SELECT symbol_y, symbol_x, trade_id, 'notional' AS rule FROM td WHERE trade_id % 7 = 2")
def q14(spark, sf):
    return quality.ledger_violations(l02(spark, sf).withColumn("entry_gross_notional", F.when(F.col("trade_id") % 7 == 2, 0.0).otherwise(F.col("entry_gross_notional"))))

"""Domain tables out of the given ones, and the SQL that makes the same.

Symbols are part brands.  The price of a day is extended price over quantity, both added up as whole numbers, so that
any engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantmill.functions.durable import written
from quantmill.functions.windows import by
from quantmill.operators import accounting, panel, positions, signals
from quantmill.sources import prices as sources

PAIR = ("symbol_y", "symbol_x")
CAPITAL, TARGET, LOOKBACK, ENTRY = 1_000_000.0, 10.0, 20, 1.0
#: Money in a pair of the walk-forward, of which the rules of cleaning are these.
NOTIONAL, MIN_COVERAGE, MAX_FILL = 10_000.0, 0.95, 3
COSTS = {"commission_bps": 5.0, "slippage_bps": 2.0, "fixed": 1.0, "borrow_y": 0.02, "borrow_x": 0.03, "financing": 0.01}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the brands by day, at most a row for each brand and day; lines are scanned once a session for all that reads them."""
    return shared("brand_prices", _brand_prices, spark, sf_dir)


def _brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"))
    sums = lines.join(part, "l_partkey").groupBy("symbol", "date").agg(F.sum("cents").alias("c"), F.sum("units").alias("u"))
    return written(sums.select("symbol", "date", (F.col("c").cast("double") / (F.col("u") * 100).cast("double")).alias("price")))


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of suppliers by day, from what they shipped; suppliers are symbols of one group.  Lines are dealt by supplier, once for all that groups by it."""
    lines = table(spark, sf_dir, "lineitem").select(F.format_string("S%09d", "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"))
    sums = lines.repartition("symbol").groupBy("symbol", "date").agg(F.sum("cents").alias("c"), F.sum("units").alias("u"))
    return sums.select("symbol", "date", (F.col("c").cast("double") / (F.col("u") * 100).cast("double")).alias("price"))


def supplier_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.format_string("S%09d", "s_suppkey").alias("symbol"), F.lit("all").alias("group_name"))


def universe(prices: DataFrame) -> DataFrame:
    return prices.select("symbol").distinct().select("symbol", F.concat(F.lit("G"), (number("symbol") % 5).cast("string")).alias("group_name"))


def number(symbol: str):
    return F.substring(symbol, 7, 9).cast("int")


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.candidate_pairs(universe(brand_prices(spark, sf_dir)))


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = brand_prices(spark, sf_dir)
    return panel.pair_panel(panel.candidate_pairs(universe(prices)), prices)


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the brands and, as denser symbols, of the seven line numbers, all out of one scan, and written: cleaning reads them four times."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("Line#"), F.col("l_linenumber")).alias("place"), F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"))
    cells = lines.join(part, "l_partkey").groupBy("brand", "place", "date").agg(F.sum("cents").alias("cents"), F.sum("units").alias("units"))
    rows = cells.select(F.explode(F.array("brand", "place")).alias("symbol"), "date", "cents", "units")
    sums = rows.groupBy("symbol", "date").agg(F.sum("cents").alias("c"), F.sum("units").alias("u"))
    return written(sums.select("symbol", "date", (F.col("c").cast("double") / (F.col("u") * 100).cast("double")).alias("price")))


def market_universe(prices: DataFrame) -> DataFrame:
    """Groups of brands as in universe(); line numbers are a group of their own."""
    group = F.when(F.col("symbol").startswith("Brand#"), F.concat(F.lit("G"), (number("symbol") % 5).cast("string"))).otherwise("LINES")
    return prices.select("symbol").distinct().select("symbol", group.alias("group_name"))


def marked_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's cleaned panel: symbol, date, price (a mark: observed, or carried 3 dates at most), observed, pos.

    Symbols with prices on under 95 % of the dates go, then dates on which a symbol has no mark; ``pos`` numbers those left.
    """
    marks = sources.clean(market_prices(spark, sf_dir), MIN_COVERAGE, MAX_FILL)
    dates = marks.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a row a date
    return marks.join(dates, "date")


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied signal table: each pair trades one side of a 20-row z-score (rounded) beyond 1."""
    rows = brand_panel(spark, sf_dir).withColumn("hedge_ratio", 1 + (number("symbol_x") % 5) / 10)
    rows = signals.standardise(rows.withColumn("spread", F.ln("price_y") - F.col("hedge_ratio") * F.ln("price_x")), LOOKBACK)
    rows = rows.withColumn("z", F.round("zscore", 6)).withColumn("side", F.when((number("symbol_y") + number("symbol_x")) % 2 == 0, 1).otherwise(-1))
    rows = rows.withColumn("state", F.when(F.col("side") * F.col("z") <= -ENTRY, F.when(F.col("side") == 1, "LONG_SPREAD").otherwise("SHORT_SPREAD")).otherwise("FLAT"))
    before = F.coalesce(F.lag("state").over(by(PAIR)), F.lit("FLAT"))
    event = F.when(F.col("state") == before, "NONE").when(F.col("state") == "LONG_SPREAD", "ENTER_LONG").when(F.col("state") == "SHORT_SPREAD", "ENTER_SHORT").otherwise("EXIT_MEAN_REVERSION")
    return rows.withColumn("event", event)


def open_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' positions, with those still open that are open in a pair's last row."""
    rows = positions.lag_decisions(signal_table(spark, sf_dir), 1).withColumn("observed_y", F.lit(True)).withColumn("observed_x", F.lit(True))
    rows = rows.withColumn("executed_state", F.coalesce("due_state", F.lit("FLAT"))).withColumn("execution_event", F.col("due_event"))
    return positions.position_schedule(rows, TARGET)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.force_close(open_schedule(spark, sf_dir))


#: Written tables that several queries of a session read, by name, session and folder.  clear() it when the folder's files change.
SHARED: dict = {}


def shared(name: str, make, spark: SparkSession, sf_dir: str):
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in SHARED:
        SHARED[key] = make(spark, sf_dir)
    return SHARED[key]


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' accounts, which returns, ledgers, exposures and portfolios all read."""
    return shared("accounts", lambda spark, sf: written(accounting.financed_schedule(schedule(spark, sf), CAPITAL, **COSTS)), spark, sf_dir)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).select(*PAIR, "pos", "date", F.col("net_return_after_carry").alias("r"))


W = "PARTITION BY symbol_y, symbol_x ORDER BY pos"
UPTO = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
CTE = {
    "px": """SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * sum(CAST(l.l_quantity AS BIGINT)) AS DOUBLE) AS price
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""",
    "sx": """SELECT format('S{:09d}', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2""",
    "uni": "SELECT DISTINCT symbol, 'G' || CAST(CAST(substr(symbol, 7) AS INT) % 5 AS VARCHAR) AS group_name FROM px",
    "pairs": "SELECT a.symbol AS symbol_y, b.symbol AS symbol_x, a.group_name FROM uni a JOIN uni b ON a.group_name = b.group_name AND a.symbol < b.symbol",
    "pp": """SELECT pr.symbol_y, pr.symbol_x, pr.group_name, y.date, y.price AS price_y, x.price AS price_x,
        row_number() OVER (PARTITION BY pr.symbol_y, pr.symbol_x ORDER BY y.date) - 1 AS pos
      FROM pairs pr JOIN px y ON y.symbol = pr.symbol_y JOIN px x ON x.symbol = pr.symbol_x AND x.date = y.date""",
    "fit": "SELECT symbol_y, symbol_x, count(*) AS n, regr_intercept(ln(price_y), ln(price_x)) AS alpha, regr_slope(ln(price_y), ln(price_x)) AS beta FROM pp GROUP BY 1, 2",
    "sp": "SELECT pp.*, alpha, beta, ln(price_y) - alpha - beta * ln(price_x) AS spread FROM pp JOIN fit USING (symbol_y, symbol_x)",
    "hs": """SELECT *, 1 + (CAST(substr(symbol_x, 7) AS INT) % 5) / 10.0::DOUBLE AS hedge_ratio,
        ln(price_y) - (1 + (CAST(substr(symbol_x, 7) AS INT) % 5) / 10.0::DOUBLE) * ln(price_x) AS spread,
        CASE WHEN (CAST(substr(symbol_y, 7) AS INT) + CAST(substr(symbol_x, 7) AS INT)) % 2 = 0 THEN 1 ELSE -1 END AS side FROM pp""",
    "zs": f"""SELECT *, CASE WHEN c = {LOOKBACK} THEN m END AS rolling_mean, CASE WHEN c = {LOOKBACK} THEN s END AS rolling_std, CASE WHEN c = {LOOKBACK} AND s > 1e-12 THEN (spread - m) / s END AS zscore,
        round(CASE WHEN c = {LOOKBACK} AND s > 1e-12 THEN (spread - m) / s END, 6) AS z
      FROM (SELECT *, count(spread) OVER w AS c, avg(spread) OVER w AS m, stddev_samp(spread) OVER w AS s FROM hs WINDOW w AS ({W} ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING))""",
    "sg": f"SELECT *, CASE WHEN side * z <= -{ENTRY} THEN CASE WHEN side = 1 THEN 'LONG_SPREAD' ELSE 'SHORT_SPREAD' END ELSE 'FLAT' END AS state FROM zs",
    "se": f"""SELECT *, CASE WHEN state = prev THEN 'NONE' WHEN state = 'LONG_SPREAD' THEN 'ENTER_LONG' WHEN state = 'SHORT_SPREAD' THEN 'ENTER_SHORT' ELSE 'EXIT_MEAN_REVERSION' END AS event
      FROM (SELECT *, coalesce(lag(state) OVER ({W}), 'FLAT') AS prev FROM sg)""",
    "fl": f"""SELECT *, coalesce(lag(state) OVER ({W}), 'FLAT') AS xs, coalesce(lag(event) OVER ({W}), 'NONE') AS xe, max(pos) OVER (PARTITION BY symbol_y, symbol_x) AS last,
        CASE WHEN hedge_ratio >= 1 THEN (1 / hedge_ratio) / (1 + 1 / hedge_ratio) ELSE 1 - hedge_ratio / (1 + hedge_ratio) END AS wy FROM se""",
    "un": f"""SELECT *, CASE WHEN xs = 'LONG_SPREAD' THEN 1 WHEN xs = 'SHORT_SPREAD' THEN -1 ELSE 0 END * {TARGET}::DOUBLE * wy / price_y AS uy,
        -(CASE WHEN xs = 'LONG_SPREAD' THEN 1 WHEN xs = 'SHORT_SPREAD' THEN -1 ELSE 0 END) * {TARGET}::DOUBLE * (1 - wy) / price_x AS ux FROM fl""",
    "ps": f"""SELECT symbol_y, symbol_x, group_name, date, pos, price_y, price_x, hedge_ratio, z, state, event,
        CASE WHEN pos = last THEN 'FLAT' ELSE xs END AS executed_state,
        CASE WHEN pos = last AND xs <> 'FLAT' THEN CASE WHEN xe LIKE 'ENTER%' THEN 'NONE' ELSE 'FORCED_EXIT' END ELSE xe END AS execution_event,
        CASE WHEN xs = 'FLAT' OR pos = last THEN 0.0 ELSE last_value(CASE WHEN xe LIKE 'ENTER%' THEN uy END IGNORE NULLS) OVER ({UPTO}) END::DOUBLE AS units_y,
        CASE WHEN xs = 'FLAT' OR pos = last THEN 0.0 ELSE last_value(CASE WHEN xe LIKE 'ENTER%' THEN ux END IGNORE NULLS) OVER ({UPTO}) END::DOUBLE AS units_x FROM un""",
    "mk": "SELECT *, units_y * price_y AS notional_y, units_x * price_x AS notional_x, abs(units_y * price_y) + abs(units_x * price_x) AS gross_exposure, units_y * price_y + units_x * price_x AS net_exposure FROM ps",
    "lg": f"""SELECT *, lag(units_y) OVER w AS ly, lag(units_x) OVER w AS lx, lag(price_y) OVER w AS qy, lag(price_x) OVER w AS qx, lag(gross_exposure) OVER w AS lge,
        coalesce(lag(executed_state) OVER w, 'FLAT') AS prev_state FROM mk WINDOW w AS ({W})""",
    "pl": f"""SELECT *, coalesce(ly * (price_y - qy), 0.0) AS pnl_y, coalesce(lx * (price_x - qx), 0.0) AS pnl_x, coalesce(ly * (price_y - qy), 0.0) + coalesce(lx * (price_x - qx), 0.0) AS gross_pnl,
        units_y - coalesce(ly, 0.0) AS delta_units_y, units_x - coalesce(lx, 0.0) AS delta_units_x,
        abs(units_y - coalesce(ly, 0.0)) * price_y AS traded_notional_y, abs(units_x - coalesce(lx, 0.0)) * price_x AS traded_notional_x,
        CASE WHEN coalesce(ly, 0.0) < 0 THEN greatest(-ly * qy, 0.0) * {COSTS["borrow_y"]} / 252 ELSE 0.0 END AS borrow_cost_y,
        CASE WHEN coalesce(lx, 0.0) < 0 THEN greatest(-lx * qx, 0.0) * {COSTS["borrow_x"]} / 252 ELSE 0.0 END AS borrow_cost_x,
        coalesce(lge * {COSTS["financing"]} / 252, 0.0) AS financing_cost,
        sum(CASE WHEN executed_state <> 'FLAT' AND prev_state = 'FLAT' THEN 1 ELSE 0 END) OVER ({UPTO}) AS tr FROM lg""",
    "co": f"""SELECT *, traded_notional_y * {COSTS["commission_bps"] / 1e4} + traded_notional_x * {COSTS["commission_bps"] / 1e4} + CASE WHEN delta_units_y = 0 THEN 0.0 ELSE {COSTS["fixed"]} END + CASE WHEN delta_units_x = 0 THEN 0.0 ELSE {COSTS["fixed"]} END AS commission_cost,
        traded_notional_y * {COSTS["slippage_bps"] / 1e4} + traded_notional_x * {COSTS["slippage_bps"] / 1e4} AS slippage_cost, borrow_cost_y + borrow_cost_x AS borrow_cost, borrow_cost_y + borrow_cost_x + financing_cost AS carry_cost,
        CASE WHEN executed_state <> 'FLAT' OR prev_state <> 'FLAT' THEN tr END AS trade_id FROM pl""",
    "cp": "SELECT *, commission_cost + slippage_cost AS transaction_cost, gross_pnl - (commission_cost + slippage_cost) AS net_pnl, gross_pnl - (commission_cost + slippage_cost) - carry_cost AS net_pnl_after_carry FROM co",
    "cu": f"""SELECT *, sum(gross_pnl) OVER u AS cumulative_gross_pnl, sum(transaction_cost) OVER u AS cumulative_transaction_cost, sum(net_pnl) OVER u AS cumulative_net_pnl, sum(carry_cost) OVER u AS cumulative_carry_cost,
        sum(borrow_cost) OVER u AS cumulative_borrow_cost, sum(financing_cost) OVER u AS cumulative_financing_cost, sum(net_pnl_after_carry) OVER u AS cumulative_net_pnl_after_carry FROM cp WINDOW u AS ({UPTO})""",
    "ac": f"""SELECT *, {CAPITAL} + cumulative_gross_pnl AS portfolio_equity, {CAPITAL} + cumulative_net_pnl AS net_portfolio_equity, {CAPITAL} + cumulative_net_pnl_after_carry AS net_equity_after_carry,
        coalesce(gross_pnl / lag({CAPITAL} + cumulative_gross_pnl) OVER w, 0.0) AS strategy_return, net_pnl / coalesce(lag({CAPITAL} + cumulative_net_pnl) OVER w, {CAPITAL}) AS net_strategy_return,
        net_pnl_after_carry / coalesce(lag({CAPITAL} + cumulative_net_pnl_after_carry) OVER w, {CAPITAL}) AS net_return_after_carry FROM cu WINDOW w AS ({W})""",
    "rt": "SELECT symbol_y, symbol_x, pos, date, net_return_after_carry AS r FROM ac",
    "eq": f"""SELECT *, greatest(max(equity) OVER ({UPTO}), 1.0) AS peak, equity / greatest(max(equity) OVER ({UPTO}), 1.0) - 1 AS drawdown FROM (SELECT *, product(1 + r) OVER ({UPTO}) AS equity FROM rt)""",
    "td": f"""SELECT symbol_y, symbol_x, trade_id, min(pos) AS entry_row, max(pos) AS exit_row, arg_min(executed_state, pos) AS side, arg_min(execution_event, pos) AS entry_event, arg_max(execution_event, pos) AS exit_event,
        arg_min(price_y, pos) AS entry_price_y, arg_min(price_x, pos) AS entry_price_x, arg_max(price_y, pos) AS exit_price_y, arg_max(price_x, pos) AS exit_price_x, arg_min(units_y, pos) AS entry_units_y, arg_min(units_x, pos) AS entry_units_x,
        arg_max(ly, pos) AS exit_units_y, arg_max(lx, pos) AS exit_units_x, max(pos) - min(pos) AS holding_period_rows, sum(gross_pnl) AS gross_pnl, sum(transaction_cost) AS transaction_cost, sum(carry_cost) AS carry_cost,
        sum(gross_pnl) - sum(transaction_cost) - sum(carry_cost) AS net_pnl FROM ac WHERE trade_id IS NOT NULL GROUP BY 1, 2, 3 HAVING arg_max(executed_state, pos) = 'FLAT'""",
}


def with_ctes(body: str) -> str:
    """``body`` after the common table expressions it needs, and those that they need."""
    import re

    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        new = [k for k in CTE if k not in needed and re.search(rf"\b(FROM|JOIN) {k}\b", text)]
        needed.update(new)
        todo += [CTE[k] for k in new]
    parts = ", ".join(f"{k} AS ({CTE[k]})" for k in CTE if k in needed)
    return f"WITH {parts} {body}" if parts else body

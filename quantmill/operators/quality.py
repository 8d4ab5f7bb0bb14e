"""Data-quality rules as queries: each returns the rows, or keys, that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.windows import by

PAIR = ("symbol_y", "symbol_x")


def differs(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """Whether two figures differ by more than a tolerance, or only one is known."""
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def accounting_violations(rows: DataFrame, capital: float, keys: tuple = PAIR) -> DataFrame:
    """(keys, pos, rule) for every broken identity of an accounting schedule."""
    c = F.col
    before = F.lag("net_equity_after_carry").over(by(keys))
    rules = {
        "gross_is_legs": differs(c("gross_pnl"), c("pnl_y") + c("pnl_x")), "cost_is_parts": differs(c("transaction_cost"), c("commission_cost") + c("slippage_cost")),
        "carry_is_parts": differs(c("carry_cost"), c("borrow_cost") + c("financing_cost")), "net_is_rest": differs(c("net_pnl_after_carry"), c("gross_pnl") - c("transaction_cost") - c("carry_cost"), 1e-9, 1e-9),
        "equity_is_capital_and_pnl": differs(c("net_equity_after_carry"), F.lit(capital) + c("cumulative_net_pnl_after_carry")), "return_uses_equity_before": (c("_n") > 1) & differs(c("net_return_after_carry"), c("net_pnl_after_carry") / c("_before"), 1e-9, 1e-9),
        "flat_has_units": (c("executed_state") == "FLAT") & ((c("units_y") != 0) | (c("units_x") != 0)),
    }
    rows = rows.withColumn("_before", before).withColumn("_n", F.row_number().over(by(keys)))
    broken = F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    return rows.select(*keys, "pos", F.explode(broken).alias("rule"))


def falling_costs(rows: DataFrame, column: str, keys: tuple = PAIR, atol: float = 1e-12) -> DataFrame:
    """Rows where a cumulative cost falls, or is known after it was unknown."""
    before, start = F.lag(column).over(by(keys)), F.row_number().over(by(keys)) == 1
    rows = rows.withColumn("_before", before).withColumn("_start", start)
    bad = (F.col(column) < F.col("_before") - F.lit(atol)) | (~F.col("_start") & F.col("_before").isNull() & F.col(column).isNotNull())
    return rows.filter(bad).select(*keys, "pos", column)


def table_differences(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of which only one table has a row, or of which a column differs."""
    a = actual.select(*keys, F.struct(*columns).alias("_a"))
    both = a.join(expected.select(*keys, F.struct(*columns).alias("_b")), keys, "full")
    numbers = {f.name for f in actual.schema if f.dataType.typeName() in ("double", "float")}
    unequal = reduce(lambda x, y: x | y, [differs(F.col(f"_a.{c}"), F.col(f"_b.{c}")) if c in numbers else ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in columns])
    reason = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(unequal, "differs")
    return both.select(*keys, reason.alias("reason")).filter("reason is not null")


def execution_violations(rows: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Fills on unobserved prices, reversals without a flat row, and more fills of a kind than decisions before them (``event``)."""
    before = F.lag("executed_state").over(by(keys))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit("FLAT")))
    filled = ~F.col("execution_event").isin("NONE", "FORCED_EXIT")
    rules = {
        "unobserved": filled & ~(F.col("observed_y") & F.col("observed_x")),
        "reversal": (F.col("executed_state") != "FLAT") & (F.col("_before") != "FLAT") & (F.col("executed_state") != F.col("_before")),
    }
    if "event" in rows.columns:
        w = Window.partitionBy(*keys, "_kind").orderBy("pos", "_fill")
        each = F.array(F.struct(F.col("event").alias("_kind"), F.lit(1).alias("_fill")), F.struct(F.when(filled, F.col("execution_event")).alias("_kind"), F.lit(0).alias("_fill")))  # a row's fill comes before its decision
        counts = rows.select(*keys, "pos", F.explode(each).alias("x")).select(*keys, "pos", "x.*").filter("_kind <> 'NONE'")
        counts = counts.withColumn("_left", F.sum(F.when(F.col("_fill") == 0, -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        over = counts.filter("_fill = 0 and _left < 0").select(*keys, "pos", F.lit(True).alias("_over"))
        rows = rows.join(over, [*keys, "pos"], "left")
        rules["undecided"] = F.coalesce("_over", F.lit(False))
    return rows.select(*keys, "pos", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("rule"))


def signal_violations(signals: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Events that do not fit the change of state: NONE with a change, entries from or exits to an open state."""
    rows = signals.withColumn("_before", F.coalesce(F.lag("state").over(by(keys)), F.lit("FLAT")))
    e, s, b = F.col("event"), F.col("state"), F.col("_before")
    rules = {"none_changes": (e == "NONE") & (s != b), "entry_not_from_flat": e.startswith("ENTER") & ((b != "FLAT") | (s == "FLAT")), "exit_not_to_flat": e.startswith("EXIT") & ((b == "FLAT") | (s != "FLAT"))}
    return rows.select(*keys, "pos", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("rule"))


def screening_violations(results: DataFrame) -> DataFrame:
    """Runs with several windows, ranks that are not 1..n, and rejected pairs with a rank."""
    out = results.groupBy("run_id").agg(F.count_distinct("formation_start", "formation_end").alias("windows"), F.max("rank").alias("top"), F.count("rank").alias("n"), F.count_distinct("rank").alias("d"), F.count_if(~F.col("selected") & F.col("rank").isNotNull()).alias("ranked_rejects"), F.count_if(F.col("symbol_y") >= F.col("symbol_x")).alias("not_canonical"))
    rules = {"several_windows": F.col("windows") > 1, "ranks": F.coalesce((F.col("top") != F.col("n")) | (F.col("n") != F.col("d")), F.lit(False)), "rejected_with_rank": F.col("ranked_rejects") > 0, "not_canonical": F.col("not_canonical") > 0}
    return out.select("run_id", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("rule"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_violations(rows: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for every check that is false; one that is null holds, as in SQL."""
    return rows.select(*keys, F.explode(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))).alias("rule"))


def screening_checks() -> dict[str, Column]:
    """What a stored screening row must satisfy: symbol_y, symbol_x, selected, rank, observations, half_life, half_life_was_infinite."""
    c = F.col
    ranked = F.when(c("selected"), F.coalesce(c("rank") > 0, F.lit(False))).otherwise(c("rank").isNull())
    return {"canonical": c("symbol_y") < c("symbol_x"), "observations": c("observations") >= 0, "rank": ranked, "half_life": ~c("half_life_was_infinite") | c("half_life").isNull()}


def run_summary_checks() -> dict[str, Column]:
    """What a stored run's summary must satisfy: the shape of its pair, the values of its stages, and counts that add up."""
    c = F.col
    pair = [c(x).isNull().cast("int") for x in ("selected_pair", "symbol_y", "symbol_x", "selected_rank")]
    done = lambda stage: c(stage) == "COMPLETED"
    return {
        "pair_shape": reduce(lambda a, b: a + b, pair).isin(0, 4) & F.coalesce(c("selected_rank") > 0, F.lit(True)),
        "screening": (c("selected") >= 0) & (c("selected") <= c("candidates")),
        "stages": c("walk_forward_stage").isin("COMPLETED", "UNAVAILABLE") & c("grid_stage").isin("COMPLETED", "NOT_REQUESTED", "UNAVAILABLE"),
        "folds": ~done("walk_forward_stage") | (c("folds") == c("completed_folds") + c("no_selection_folds") + c("insufficient_folds")),
        "scenarios": ~done("grid_stage") | (c("scenarios") == c("completed_scenarios") + c("invalid_scenarios") + c("failed_scenarios")),
    }


def panel_violations(prices: DataFrame) -> DataFrame:
    """Repeated (symbol, date) and prices that are not positive."""
    n = F.count("*").over(Window.partitionBy("symbol", "date"))
    return prices.select("symbol", "date", "price", n.alias("n")).select("symbol", "date", F.when(F.col("n") > 1, "repeated").when(F.col("price") <= 0, "not_positive").alias("rule")).filter("rule is not null")


def fold_violations(folds: DataFrame, n: int) -> DataFrame:
    """Folds whose bounds do not touch or leave the panel."""
    c = F.col
    rule = F.when(c("formation_end_pos") + 1 != c("trading_start_pos"), "gap").when((c("formation_start_pos") < 0) | (c("trading_end_pos") >= n), "outside").when((c("formation_start_pos") > c("formation_end_pos")) | (c("trading_start_pos") > c("trading_end_pos")), "empty")
    return folds.select("fold_id", rule.alias("rule")).filter("rule is not null")


def ledger_violations(ledger: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Repeated trade ids, entry notionals that are not positive, negative holding periods."""
    n = F.count("*").over(Window.partitionBy(*keys, "trade_id"))
    rule = F.when(F.col("_n") > 1, "repeated").when(~(F.col("entry_gross_notional") > 0), "notional").when(F.col("holding_period_rows") < 0, "holding")
    return ledger.withColumn("_n", n).select(*keys, "trade_id", rule.alias("rule")).filter("rule is not null")


def portfolio_violations(sleeves: DataFrame, portfolio: DataFrame, cash_weight: float, capital: float) -> DataFrame:
    """Rows where equity is not cash and the sleeves, or P&L not the sleeves' sum."""
    sums = sleeves.groupBy("pos").agg(F.when(F.count("sleeve_equity") == F.count("*"), F.sum("sleeve_equity")).alias("_e"), F.when(F.count("sleeve_pnl") == F.count("*"), F.sum("sleeve_pnl")).alias("_p"))
    both = portfolio.filter("portfolio_equity is not null").join(sums, "pos")
    rule = F.when(differs(F.col("portfolio_equity"), F.col("_e") + F.lit(capital * cash_weight), 1e-9, 1e-9), "equity").when(differs(F.col("portfolio_pnl"), F.col("_p"), 1e-9, 1e-6), "pnl")
    return both.select("pos", rule.alias("rule")).filter("rule is not null")


def risk_violations(statuses: DataFrame, policy: DataFrame) -> DataFrame:
    """Statuses that do not follow from value and limit, intents without a breach or an action after, actions without an intent before."""
    breach = F.coalesce(F.when(F.col("boundary") == "minimum", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit")), F.lit(False))
    known = F.col("value").isNotNull() & F.col("limit").isNotNull()
    rule = F.when((F.col("status") == "BREACH") & ~breach, "breach_within_limit").when((F.col("status") == "WITHIN_LIMIT") & breach, "beyond_limit_unnoticed").when((F.col("status") == "WITHIN_LIMIT") & ~known, "unknown_within_limit")
    wrong = statuses.select("pos", rule.alias("rule")).filter("rule is not null")
    breaches = statuses.filter("status = 'BREACH'").select("pos").distinct()
    intents = policy.filter("intent <> 'NONE'").join(breaches, "pos", "left_anti").select("pos", F.lit("intent_without_breach").alias("rule"))
    days = Window.partitionBy(F.lit(1)).orderBy("pos")  # a row a day
    before, after = F.lag("intent").over(days), F.lead("requested_action").over(days)
    idle = policy.withColumn("_after", after).filter("intent <> 'NONE' and _after is not null and _after <> intent").select("pos", F.lit("intent_without_action").alias("rule"))
    actions = policy.withColumn("_before", before).filter("requested_action <> 'NONE' and coalesce(_before, 'NONE') <> requested_action").select("pos", F.lit("action_without_intent").alias("rule"))
    return wrong.union(intents).union(idle).union(actions)


def breach_record_violations(statuses: DataFrame, records: DataFrame) -> DataFrame:
    """(pos, control, rule): breaches without exactly one record, and records without a breach."""
    keys = ["pos", "control"]
    made = records.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = statuses.filter("status = 'BREACH'").select(*keys, F.lit(True).alias("_breach")).join(made, keys, "full")
    rule = F.when(F.col("_breach").isNull(), "no_breach").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.select(*keys, rule.alias("rule")).filter("rule is not null")


def leverage_violations(schedule: DataFrame, executions: DataFrame) -> DataFrame:
    """(pos, rule, is_error) of a portfolio schedule: over its limit, or not to be evaluated, by whether a pair trades on the row.

    A breach on a row with executions (one row a ``pos`` here) is an error, one by drift is only reported; what cannot
    be evaluated is an error on the first row and on rows with executions.
    """
    rows = schedule.join(executions.select("pos", F.lit(True).alias("_trades")).distinct(), "pos", "left")
    first, trades = F.col("pos") == F.min("pos").over(Window.partitionBy(F.lit(1))), F.coalesce("_trades", F.lit(False))
    status = F.col("leverage_status")
    rule = F.when((status == "BREACH") & trades, "execution_breach").when(status == "BREACH", "drift_breach").when((status == "UNEVALUABLE") & (trades | first), "unevaluable")
    return rows.select("pos", rule.alias("rule")).filter("rule is not null").withColumn("is_error", F.col("rule") != "drift_breach")


def run_violations(calendar: DataFrame, coverage: DataFrame) -> DataFrame:
    """A walk-forward report whose counts do not add up to the calendar's."""
    real = calendar.agg(F.count("*").alias("_rows"), F.count("r").alias("_known"))
    both = coverage.crossJoin(F.broadcast(real))  # one row each
    rules = {"rows": F.col("scheduled_rows") != F.col("_rows"), "known": F.col("known_rows") != F.col("_known"), "folds": F.col("folds") != F.col("completed") + F.col("no_selection") + F.col("insufficient")}
    return both.select(F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("rule"))


def content_digest(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(group, digest): a SHA-256 tree over each group's rows; any changed, lost or repeated row changes it.

    Equal rows are one line, "digest:count".  Lines are dealt by their first four hex digits; a leaf's digest is that of
    its lines in order, a group's that of its leaves ("digits=digest") in order.  So a group of any size needs no more
    together than a 65,536th of its lines, and 65,536 leaves.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    lines = rows.select(F.col(group), row.alias("_d")).groupBy(group, "_d").agg(F.count("*").alias("_n"))
    leaves = lines.groupBy(group, F.substring("_d", 1, 4).alias("_leaf")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "_d", "_n")))), 256).alias("_d"))
    return leaves.groupBy(group).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws("=", "_leaf", "_d")))), 256).alias("digest"))

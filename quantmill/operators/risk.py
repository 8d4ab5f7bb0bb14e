"""Portfolio risk controls: observed metrics, statuses against limits, a sticky action, breaches and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control, the metric it looks at, and the side of its limit.
CONTROLS = (
    ("gross_exposure", "gross_exposure_ratio", "maximum"), ("net_exposure", "abs_net_exposure_ratio", "maximum"), ("pair_weight", "largest_pair_equity_weight", "maximum"),
    ("symbol_exposure", "largest_symbol_ratio", "maximum"), ("active_pairs", "active_pair_count", "maximum"), ("drawdown", "drawdown_magnitude", "maximum"),
    ("portfolio_equity", "portfolio_equity_ratio", "minimum"), ("long_exposure", "long_exposure_ratio", "maximum"), ("short_exposure", "short_exposure_ratio", "maximum"),
    ("insolvent_sleeves", "insolvent_sleeve_count", "maximum"),
)
SLACK = 1e-12


def observed_metrics(portfolio: DataFrame, capital: float) -> DataFrame:
    """Ratios to equity, peaks and drawdowns by ``pos``; null after the first row of unknown or zero equity.

    ``portfolio`` is one portfolio: pos, portfolio_equity, total_gross, total_net, total_long, total_short,
    largest_sleeve_equity, largest_symbol_gross, active_pair_count, insolvent_sleeves.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("pos")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    e = F.col("portfolio_equity")
    lost = (F.max(e.isNull().cast("int")).over(upto) == 1) | F.coalesce(F.max((e == 0).cast("int")).over(earlier) == 1, F.lit(False))
    rows = portfolio.withColumn("_e", F.when(~lost, e)).withColumn("running_equity_peak", F.greatest(F.lit(capital), F.max("_e").over(upto)))
    rows = rows.withColumn("running_equity_peak", F.when(F.col("_e").isNotNull(), F.col("running_equity_peak")))
    rows = rows.withColumn("drawdown", F.col("_e") / F.col("running_equity_peak") - 1)
    positive = F.when(F.col("_e") > 0, F.col("_e"))
    return rows.select(
        "pos", (F.col("total_gross") / positive).alias("gross_exposure_ratio"), (F.abs("total_net") / positive).alias("abs_net_exposure_ratio"), (F.col("largest_sleeve_equity") / positive).alias("largest_pair_equity_weight"),
        (F.col("largest_symbol_gross") / positive).alias("largest_symbol_ratio"), F.col("active_pair_count").cast("double").alias("active_pair_count"), "running_equity_peak", "drawdown",
        F.greatest(-F.col("drawdown"), F.lit(0.0)).alias("drawdown_magnitude"), (F.col("_e") / F.lit(capital)).alias("portfolio_equity_ratio"), (F.col("total_long") / positive).alias("long_exposure_ratio"),
        (F.col("total_short") / positive).alias("short_exposure_ratio"), F.col("insolvent_sleeves").cast("double").alias("insolvent_sleeve_count"), F.coalesce(e == 0, F.lit(False)).alias("terminal"),
    )


def invalid_limits(limits: DataFrame, keys: tuple = ()) -> DataFrame:
    """Limits of unknown controls, repeated controls (of one policy, named by ``keys``), negative or non-finite values."""
    names = [c for c, _, _ in CONTROLS]
    n = F.count("*").over(Window.partitionBy(*keys, "control"))
    reason = F.when(~F.col("control").isin(names), "unknown_control").when(n > 1, "repeated").when(F.isnan("limit") | (F.col("limit") < 0) | (F.col("limit") == float("inf")), "value")
    return limits.withColumn("reason", reason).filter("reason is not null")


def control_statuses(observed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pos, control, value, limit, status) for every row and control; limits: (control, limit), ten rows at most."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("control"), F.col(m).alias("value"), F.lit(b).alias("boundary")) for k, (c, m, b) in enumerate(CONTROLS)])
    rows = observed.select("pos", F.explode(each).alias("x")).select("pos", "x.*").join(F.broadcast(limits), "control", "left")
    over = F.when(F.col("boundary") == "minimum", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit") + F.when(F.col("control") == "gross_exposure", SLACK).otherwise(0.0))
    status = F.when(F.col("limit").isNull(), "NOT_CONFIGURED").when(F.col("value").isNull(), "UNEVALUABLE").when(over, "BREACH").otherwise("WITHIN_LIMIT")
    return rows.withColumn("status", status)


def overall_status(statuses: DataFrame) -> DataFrame:
    """Counts by row and the overall status: BREACH before UNEVALUABLE before WITHIN_LIMIT."""
    of = lambda s: F.count_if(F.col("status") == s)
    rows = statuses.groupBy("pos").agg(of("BREACH").alias("breaches"), of("UNEVALUABLE").alias("unevaluable"), of("WITHIN_LIMIT").alias("within"), (F.count("*") - of("NOT_CONFIGURED")).alias("configured"))
    status = F.when(F.col("configured") == 0, "NOT_CONFIGURED").when(F.col("breaches") > 0, "BREACH").when(F.col("unevaluable") > 0, "UNEVALUABLE").otherwise("WITHIN_LIMIT")
    return rows.withColumn("overall_status", status)


def risk_policy(overall: DataFrame, observed: DataFrame, action: str = "HALT_NEW_ENTRIES") -> DataFrame:
    """By row: risk_state, requested_action, intent and the row it takes effect.

    The first breach before any terminal row, not on the last row, emits the action for the next row; it sticks, and a
    terminal row overrides it.
    """
    whole = Window.partitionBy(F.lit(1))
    rows = overall.join(observed.select("pos", "terminal"), "pos")
    end = F.min(F.when(F.col("terminal"), F.col("pos"))).over(whole)
    rows = rows.withColumn("_end", end).withColumn("_last", F.max("pos").over(whole))
    can = (F.col("breaches") > 0) & (F.col("_end").isNull() | (F.col("pos") < F.col("_end"))) & (F.col("pos") < F.col("_last")) & F.lit(action != "NONE")
    rows = rows.withColumn("_at", F.min(F.when(can, F.col("pos"))).over(whole))
    state = {"HALT_NEW_ENTRIES": "ENTRY_HALTED", "LIQUIDATE_ALL": "LIQUIDATION_REQUIRED"}.get(action, "NORMAL")
    return rows.select(
        "pos", F.when(F.col("pos") >= F.col("_end"), "TERMINAL").when(F.col("pos") > F.col("_at"), state).otherwise("NORMAL").alias("risk_state"),
        F.when(F.col("pos") == F.col("_at") + 1, action).otherwise("NONE").alias("requested_action"), F.when(F.col("pos") == F.col("_at"), action).otherwise("NONE").alias("intent"),
        F.when(F.col("pos") == F.col("_at"), F.col("_at") + 1).alias("effective_pos"),
    )


def breach_records(statuses: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per breach, in control order, with a message and the row's intent."""
    relation = F.when(F.col("boundary") == "minimum", "is below minimum").otherwise("exceeds maximum")
    message = F.format_string("%s observed value %.6f %s %.6f.", "control", "value", relation, "limit")
    return statuses.filter("status = 'BREACH'").withColumn("message", message).join(policy.select("pos", "intent", "effective_pos"), "pos")


def risk_schedule(observed: DataFrame, overall: DataFrame, policy: DataFrame) -> DataFrame:
    return observed.join(overall, "pos").join(policy, "pos")


def risk_summary(statuses: DataFrame) -> DataFrame:
    """Per control: breaches, first and last of them, rows that could not be evaluated, extremes."""
    breach = F.col("status") == "BREACH"
    return statuses.groupBy("control").agg(
        F.count_if(breach).alias("breaches"), F.min(F.when(breach, F.col("pos"))).alias("first_breach"), F.max(F.when(breach, F.col("pos"))).alias("last_breach"),
        F.count_if(F.col("status") == "UNEVALUABLE").alias("unevaluable"), F.max("value").alias("highest"), F.min("value").alias("lowest"),
    )

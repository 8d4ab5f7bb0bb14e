"""Parameter grids and the robustness of results over scenarios.  A scenario is a row; results carry scenario_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantmill.operators.panel import common_labels

MAX_SCENARIOS = 256


def scenario_id(columns: list[str]) -> Column:
    """Stable: the first 12 hex digits of a SHA-256 over the parameters in order."""
    return F.concat(F.lit("scenario-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 12))


def parameter_grid(spark: SparkSession, axes: dict[str, list], baseline: dict, most: int = MAX_SCENARIOS) -> DataFrame:
    """All combinations of the axes' values; each axis holds the baseline's value.  The size is known beforehand."""
    values = {k: sorted({*v, baseline[k]}) for k, v in axes.items()}
    size = reduce(lambda n, v: n * len(v), values.values(), 1)
    if size > most:
        raise ValueError(f"{size} scenarios; {most} are allowed")
    one = spark.range(1).select(*[F.explode(F.array(*map(F.lit, v))).alias(k) for k, v in list(values.items())[:1]])
    for k, v in list(values.items())[1:]:
        one = one.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    for k in baseline:
        if k not in values:
            one = one.withColumn(k, F.lit(baseline[k]))
    names = list(baseline)
    same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(baseline[k]) for k in names])
    return one.select(scenario_id(names).alias("scenario_id"), *names, same.alias("is_baseline"))


def configuration_errors(scenarios: DataFrame) -> DataFrame:
    """The first contradiction of each scenario, null if there is none."""
    c = F.col
    error = F.when(c("exit_z") < 0, "exit_z must not be negative").when(c("entry_z") <= c("exit_z"), "entry_z must be above exit_z").when(c("stop_z") <= c("entry_z"), "stop_z must be above entry_z").when(c("zscore_lookback") < 2, "zscore_lookback must be 2 or more").when(c("zscore_lookback") > c("formation_window"), "zscore_lookback must fit into formation")
    return scenarios.withColumn("error", error)


def scenario_folds(scenarios: DataFrame, n: int) -> DataFrame:
    """Folds of each scenario over n rows."""
    last = F.lit(n).cast("long") - F.col("formation_window") - F.col("trading_window")
    out = scenarios.filter(last >= 0).select("scenario_id", "formation_window", "trading_window", F.posexplode(F.sequence(F.lit(0).cast("long"), last, F.col("trading_window").cast("long"))).alias("fold_id", "at"))
    return out.select("scenario_id", F.col("fold_id").cast("long"), F.col("at").alias("formation_start_pos"), (F.col("at") + F.col("formation_window") - 1).alias("formation_end_pos"), (F.col("at") + F.col("formation_window")).alias("trading_start_pos"), (F.col("at") + F.col("formation_window") + F.col("trading_window") - 1).alias("trading_end_pos"))


def distribution(values: DataFrame, metric: str, value: str = "value") -> DataFrame:
    """Count, extremes, mean and quartiles (linear interpolation) of finite values by metric."""
    fine = values.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = fine.groupBy(metric).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), q.alias("q"), F.max(value).alias("highest"), F.avg(value).alias("mean"))
    return out.select(metric, "n", "lowest", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "highest", "mean")


def positive_fractions(values: DataFrame, metric: str, value: str = "value") -> DataFrame:
    """Share of positive values among those defined, and among all."""
    up = F.count_if(F.col(value) > 0)
    return values.groupBy(metric).agg(F.count("*").alias("eligible"), F.count(value).alias("defined"), F.when(F.count(value) > 0, up / F.count(value)).alias("of_defined"), (up / F.count("*")).alias("of_eligible"))


def long_parameters(scenarios: DataFrame, axes: list[str]) -> DataFrame:
    """(scenario_id, parameter, value), a row per axis."""
    return scenarios.unpivot(["scenario_id"], [F.col(a).cast("double").alias(a) for a in axes], "parameter", "value")


def axis_metadata(scenarios: DataFrame, axes: list[str]) -> DataFrame:
    """Per axis: its values in order and the spacing to the next."""
    values = long_parameters(scenarios, axes).select("parameter", "value").distinct()
    return values.withColumn("step", F.lead("value").over(Window.partitionBy("parameter").orderBy("value")) - F.col("value"))


def one_parameter_variants(scenarios: DataFrame, axes: list[str]) -> DataFrame:
    """Scenarios that differ from the baseline in one axis, with the distance in places and whether it is adjacent."""
    rows = long_parameters(scenarios, axes).join(F.broadcast(scenarios.filter("is_baseline").select(*[F.col(a).cast("double").alias(a) for a in axes]).unpivot([], axes, "parameter", "base")), "parameter")
    rank = F.dense_rank().over(Window.partitionBy("parameter").orderBy("value"))
    rows = rows.withColumn("place", rank).withColumn("base_place", F.max(F.when(F.col("value") == F.col("base"), F.col("place"))).over(Window.partitionBy("parameter")))
    n = F.count_if(F.col("value") != F.col("base")).over(Window.partitionBy("scenario_id"))
    rows = rows.withColumn("changed", n).filter((F.col("changed") == 1) & (F.col("value") != F.col("base")))
    places = F.abs(F.col("place") - F.col("base_place"))
    return rows.select("scenario_id", "parameter", "value", "base", places.alias("places"), (places == 1).alias("adjacent"))


#: Statuses of scenarios that take no part in comparisons.
UNFIT = ("INVALID", "FAILED")


def common_horizon(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``rows`` (scenario_id, pos, ...) of the scenarios that can be compared, at the positions which all of them schedule.

    scenarios: scenario_id and status.  Which positions these are depends on schedules alone, never on returns; a
    scenario without any row takes no part.
    """
    able = rows.join(scenarios.filter(~F.col("status").isin(*UNFIT)).select("scenario_id"), "scenario_id", "left_semi")
    return able.join(common_labels(able, "scenario_id", "pos"), "pos", "left_semi")


def sensitivity_summary(scenarios: DataFrame, common: DataFrame, variants: DataFrame, severity: float = -0.2) -> DataFrame:
    """One row: scenarios by status, and figures on the common horizon, which are null unless every eligible scenario has them.

    scenarios: scenario_id, status, is_baseline.  common: scenario_id, total_return, sharpe_ratio, maximum_drawdown, null
    where they are not available.  variants: the scenarios that differ from the baseline in one parameter.
    """
    names = ("total_return", "sharpe_ratio", "maximum_drawdown")
    rows = scenarios.select("scenario_id", "status", "is_baseline").join(common.select("scenario_id", *names), "scenario_id", "left").join(variants.select("scenario_id").distinct().withColumn("variant", F.lit(True)), "scenario_id", "left")
    fit = ~F.col("status").isin(*UNFIT)
    base = F.max(F.when(F.col("is_baseline"), F.col("total_return"))).over(Window.partitionBy(F.lit(1)))  # a row a scenario
    rows = rows.withColumn("_base", base).withColumn("fit", fit).withColumn("variant", F.coalesce("variant", F.lit(False)) & fit)
    of = lambda condition, known: F.try_divide(F.count_if(condition), F.count_if(known & condition.isNotNull()))
    t, s, d, v = F.col("total_return"), F.col("sharpe_ratio"), F.col("maximum_drawdown"), F.col("variant")
    count = lambda *status: F.count_if(F.col("status").isin(*status))
    out = rows.agg(
        F.count("*").alias("scenarios"), count("COMPLETED").alias("completed"), count("NO_FOLDS", "INCOMPLETE").alias("unavailable"), count("INVALID").alias("invalid"), count("FAILED").alias("failed"),
        F.count_if("fit").alias("eligible"), F.count_if(F.col("fit") & t.isNotNull()).alias("defined"), F.count_if("variant").alias("variants"), F.max("_base").alias("baseline_total_return"),
        F.min(F.when(F.col("fit"), t)).alias("worst"), F.max(F.when(F.col("fit"), t)).alias("best"), of((t > 0) & F.col("fit"), F.col("fit")).alias("positive_share"), of((s > 0) & F.col("fit"), F.col("fit")).alias("positive_sharpe_share"),
        of((d >= severity) & F.col("fit"), F.col("fit")).alias("mild_drawdown_share"), of((F.signum(t) == F.signum("_base")) & v, v).alias("variant_sign_agreement"), of((s > 0) & v, v).alias("variant_positive_sharpe_share"),
    ).withColumn("headline", (F.col("eligible") > 0) & (F.col("defined") == F.col("eligible")))
    for c in ("baseline_total_return", "worst", "best", "positive_share", "positive_sharpe_share", "mild_drawdown_share", "variant_sign_agreement", "variant_positive_sharpe_share"):
        out = out.withColumn(c, F.when(F.col("headline"), F.col(c)))
    return out

"""End-to-end jobs: screening, in-sample diagnostic, walk-forward, grid and validation as one set of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantmill.functions.durable import written
from quantmill.operators import accounting, grid, hedge, inference, positions, signals, walkforward
from quantmill.sources import tables

PAIR = ("symbol_y", "symbol_x")
#: Settings that a run carries and no stage applies.
UNENFORCED = ("target_volatility", "gross_leverage_cap", "minimum_selected_pairs")


def configuration_snapshot(spark: SparkSession, settings: dict, unenforced: tuple = UNENFORCED) -> DataFrame:
    """One row: settings as JSON in name order, those that are configured but not enforced, and a digest."""
    row = spark.range(1).select(*[F.lit(settings[k]).alias(k) for k in sorted(settings)])
    return configuration_snapshots(row, (), unenforced)


def configuration_snapshots(runs: DataFrame, keys: tuple = ("run_id",), unenforced: tuple = UNENFORCED) -> DataFrame:
    """As configuration_snapshot, for a table of runs: every column but ``keys`` is a setting, and null ones are not configured."""
    settings = sorted(c for c in runs.columns if c not in keys)
    names = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), c) for c in unenforced if c in settings])
    return runs.select(*keys, F.to_json(F.struct(*settings)).alias("settings"), names.alias("unenforced")).withColumn("digest", F.sha2("settings", 256))


def in_sample_diagnostic(panel: DataFrame, screened: DataFrame, rules: signals.Rules, lookback: int = 120, window: int = 60, target: float = 100_000.0, capital: float = 1_000_000.0, costs: dict | None = None) -> DataFrame:
    """Accounting of the rank-1 pair with rolling hedge ratios; a beta that is not positive only blocks entries.

    The choice of the pair stays a join, so nothing is collected.
    """
    rows = panel.join(screened.filter("rank = 1").select(*PAIR), list(PAIR), "left_semi")
    rows = signals.standardise(hedge.rolling_ols(rows, lookback), window)
    rows = positions.available_hedge(rows, 1).withColumn("hedge_ratio", F.when(F.col("hedge_ratio") > 0, F.col("hedge_ratio")))
    for leg in "yx":
        if f"observed_{leg}" not in rows.columns:
            rows = rows.withColumn(f"observed_{leg}", F.lit(True))
    ready = rows.withColumn("tradable", F.col("observed_y") & F.col("observed_x")).withColumn("sized", F.col("hedge_ratio").isNotNull())
    fills = signals.filled_signals(ready, rules, 1, True).select(*PAIR, "pos", "executed_state", "execution_event")
    schedule = positions.force_close(positions.position_schedule(rows.join(fills, [*PAIR, "pos"]), target))
    return accounting.financed_schedule(schedule, capital, **(costs or {}))


RECORD = "run_id string, stage string, status string, rows long, reason string, recorded long"


def run_store(root: str) -> tables.Table:
    """Where runs keep what became of their stages."""
    return tables.Table(root, RECORD, ("run_id", "stage"), "recorded", "substring(run_id, 1, 7)")


@dataclass(frozen=True)
class Request:
    """What a run is asked for.  scenarios: parameter_grid() rows, None for no grid; dates: positions of the panel."""

    folds: DataFrame
    rules: signals.Rules
    minimum: int = 100
    fdr: float = 0.05
    scenarios: DataFrame | None = None
    dates: int = 0
    validate: bool = True
    options: dict = field(default_factory=dict)


class Unavailable(Exception):
    """A stage has nothing to work on; the message says why."""


def research(panel: DataFrame, request: Request, store: tables.Table | None = None, run_id: str = "run") -> dict[str, DataFrame]:
    """The tables of a research run, by stage, and ``record``: run_id, stage, status, rows and reason of each stage.

    Stages: screening, diagnostic (the rank-1 pair, in sample), traded and calendar (the walk-forward, which does not
    depend on the diagnostic), coverage, report, grid (a row a scenario) and validation.  A stage's table is written
    before the next one starts.  Status: COMPLETED; NOT_REQUESTED; UNAVAILABLE, with the reason, where a stage before it
    left nothing to work on; FAILED where it broke off.  Either way the other stages go on, and a stage without a table
    has none in the result.  The record is merged into ``store`` as each stage ends, so a run that is lost midway has
    left the stages before.
    """
    spark, tables_, record = panel.sparkSession, {}, []

    def note(stage: str, status: str, rows: int = 0, reason: str | None = None) -> None:
        record.append((run_id, stage, status, rows, reason, len(record)))
        if store is not None:
            store.merge(spark.createDataFrame(record[-1:], RECORD))

    def stage(name: str, make, *needs: str, requested: bool = True) -> None:
        if not requested:
            return note(name, "NOT_REQUESTED")
        try:
            for n in needs:
                if n not in tables_:
                    raise Unavailable(f"{n} is not available")
            made = written(make())
            rows = made.count()
            if not rows:
                raise Unavailable("no rows")
            tables_[name] = made
            note(name, "COMPLETED", rows)
        except Unavailable as e:
            note(name, "UNAVAILABLE", 0, str(e))
        except Exception as e:  # the other stages' results are kept
            note(name, "FAILED", 0, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300])

    r, walk = request, {}

    def walked() -> DataFrame:
        if r.folds.isEmpty():
            raise Unavailable("no fold fits into the panel")
        walk["screened"], walk["traded"] = walkforward.run_folds(panel, r.folds, r.rules, minimum=r.minimum, fdr=r.fdr, **r.options)
        return walkforward.calendar_returns(walkforward.fold_status(r.folds, walk["screened"].filter("corrected_p is not null"), walk["traded"]), walk["traded"])

    whole = lambda: tables_["calendar"].withColumn("run", F.lit("run"))
    money = {k: v for k, v in r.options.items() if k in ("target", "capital", "costs")}
    limits = {k: v for k, v in r.options.items() if k in ("longest", "hurst_limit")}

    def scenario_table() -> DataFrame:
        every = written(grid.configuration_errors(r.scenarios))
        valid = every.filter("error is null")
        lookbacks = sorted(x[0] for x in valid.select("zscore_lookback").distinct().collect())  # an axis of the grid
        calendar, traded = walkforward.run_grid(panel, valid, grid.scenario_folds(valid, r.dates), lookbacks, r.minimum, r.fdr, **limits, **money)
        return walkforward.scenario_reports(every, calendar, traded)

    stage("screening", lambda: hedge.screen(panel, (), r.minimum, r.fdr, **limits))
    stage("diagnostic", lambda: in_sample_diagnostic(panel, tables_["screening"], r.rules, **money), "screening")
    stage("calendar", walked)
    stage("traded", lambda: walk["traded"], "calendar")
    stage("coverage", lambda: walkforward.coverage(tables_["calendar"]), "calendar")
    stage("report", lambda: walkforward.return_report(whole(), ("run",)), "calendar")
    stage("grid", scenario_table, requested=r.scenarios is not None)
    stage("validation", lambda: inference.probabilistic_sharpe(whole(), 0.0, ("run",)), "calendar", requested=r.validate)
    kept = store.read(spark).filter(F.col("run_id") == run_id) if store is not None else spark.createDataFrame(record, RECORD)
    return {**tables_, "record": kept.orderBy("recorded").drop("recorded")}

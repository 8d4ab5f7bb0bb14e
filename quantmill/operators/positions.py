"""Positions from states and fills: lagged decisions, sizing, marks, forced closes and hedge rebalancing.

All of it is window and column expressions over ``pos``, and a fold over the rows of a position for rebalancing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.windows import by, cum

PAIR = ("symbol_y", "symbol_x")
ENTRIES = ("ENTER_LONG", "ENTER_SHORT")


def lag_decisions(signals: DataFrame, lag: int = 1, keys: tuple = PAIR) -> DataFrame:
    """due_state and due_event: what was decided ``lag`` rows before; the last decisions never fall due."""
    w = by(keys)
    return signals.withColumn("due_state", F.lag("state", lag).over(w)).withColumn("due_event", F.coalesce(F.lag("event", lag).over(w), F.lit("NONE")))


def available_hedge(rows: DataFrame, lag: int = 1, keys: tuple = PAIR) -> DataFrame:
    """hedge_ratio as it was known ``lag`` rows before (column beta)."""
    return rows.withColumn("hedge_ratio", F.lag("beta", lag).over(by(keys)))


def sign(state: Column) -> Column:
    return F.when(state == "LONG_SPREAD", 1).when(state == "SHORT_SPREAD", -1).otherwise(0)


def pair_units(state: Column, price_y: Column, price_x: Column, beta: Column, target: float) -> tuple[Column, Column]:
    """Signed units of both legs for a gross notional; weights 1 / (1 + beta) and beta / (1 + beta); null for beta <= 0."""
    weight_y = F.when(beta >= 1, (1 / beta) / (1 + 1 / beta)).when(beta > 0, 1 - beta / (1 + beta))
    weight_x = F.when(beta >= 1, 1 - (1 / beta) / (1 + 1 / beta)).when(beta > 0, beta / (1 + beta))
    side = sign(state)
    return side * F.lit(target) * weight_y / price_y, -side * F.lit(target) * weight_x / price_x


def position_schedule(fills: DataFrame, target: float, keys: tuple = PAIR) -> DataFrame:
    """``fills`` (executed_state, execution_event, prices, hedge_ratio) with units_y, units_x held from fill to fill, and marks."""
    w, entered = cum(keys), F.col("execution_event").isin(*ENTRIES)
    y, x = pair_units(F.col("executed_state"), F.col("price_y"), F.col("price_x"), F.col("hedge_ratio"), target)
    for name, value in (("units_y", y), ("units_x", x)):
        held = F.last(F.when(entered, value), ignorenulls=True).over(w)
        fills = fills.withColumn(name, F.when(F.col("executed_state") == "FLAT", 0.0).otherwise(held))
    return mark(fills)


def mark(rows: DataFrame) -> DataFrame:
    """Leg notionals, gross and net; a flat row has zeros, an open row with a missing price has nulls."""
    flat = F.col("executed_state") == "FLAT"
    for leg in "yx":
        rows = rows.withColumn(f"notional_{leg}", F.when(flat, 0.0).otherwise(F.col(f"units_{leg}") * F.col(f"price_{leg}")))
    rows = rows.withColumn("gross_exposure", F.abs("notional_y") + F.abs("notional_x"))
    return rows.withColumn("net_exposure", F.col("notional_y") + F.col("notional_x"))


def force_close(rows: DataFrame, keys: tuple = PAIR) -> DataFrame:
    """Closes what is open on the last row, if both prices are observed there; an entry filled on it does not happen."""
    last = F.col("pos") == F.max("pos").over(Window.partitionBy(*keys))
    open_ = last & (F.col("executed_state") != "FLAT")
    entered = open_ & F.col("execution_event").isin(*ENTRIES)
    closes = entered | (open_ & F.col("price_y").isNotNull() & F.col("price_x").isNotNull() & F.col("observed_y") & F.col("observed_x"))
    event = F.when(entered, "NONE").when(closes, "FORCED_EXIT").otherwise(F.col("execution_event"))
    rows = rows.withColumn("_closes", closes).withColumn("execution_event", event)
    rows = rows.withColumn("executed_state", F.when(F.col("_closes"), "FLAT").otherwise(F.col("executed_state")))
    for name in ("units_y", "units_x", "notional_y", "notional_x", "gross_exposure", "net_exposure"):
        rows = rows.withColumn(name, F.when(F.col("_closes"), 0.0).otherwise(F.col(name)))
    return rows.drop("_closes")


def rebalance(rows: DataFrame, target: float, threshold: float, keys: tuple = PAIR) -> DataFrame:
    """Resizes open positions when the hedge ratio has moved by ``threshold`` of that of the last sizing.

    Adds rebalance and replaces units_y, units_x.  What a row is compared with is the last sizing, so this is a fold
    over each key's rows that are open; it gives the rows that size a position anew, and units last until the next.  A
    row with an unobserved or unknown input sizes nothing; a sizing that leaves the units as they are is no rebalance.
    """
    open_, entered = F.col("executed_state") != "FLAT", F.col("execution_event").isin(*ENTRIES)
    usable = F.col("hedge_ratio").isNotNull() & F.col("price_y").isNotNull() & F.col("price_x").isNotNull() & F.col("observed_y") & F.col("observed_x")
    y, x = pair_units(F.col("executed_state"), F.col("price_y"), F.col("price_x"), F.col("hedge_ratio"), target)
    facts = F.when(open_, F.struct("pos", entered.alias("entered"), F.coalesce(usable, F.lit(False)).alias("usable"), F.col("hedge_ratio").alias("beta"), y.alias("y"), x.alias("x"), "units_y", "units_x"))
    size = "struct<pos:bigint,beta:double,y:double,x:double,changed:boolean>"
    start = F.struct(F.lit(None).cast(size).alias("last"), F.array().cast(f"array<{size}>").alias("out"))
    differs = lambda a, b: F.abs(a - b) > 1e-12 + 1e-12 * F.abs(b)

    def step(s: Column, r: Column) -> Column:
        last = s["last"]
        sized = lambda a, b, changed: F.struct(r["pos"].cast("bigint").alias("pos"), r["beta"].alias("beta"), a.alias("y"), b.alias("x"), changed.alias("changed"))
        moved = r["usable"] & (r["beta"] != last["beta"]) & (F.abs(r["beta"] - last["beta"]) / F.abs(last["beta"]) >= threshold)
        changed = differs(r["y"], last["y"]) | differs(r["x"], last["x"])
        now = F.when(r["entered"], sized(r["units_y"], r["units_x"], F.lit(False))).when(moved, sized(F.when(changed, r["y"]).otherwise(last["y"]), F.when(changed, r["x"]).otherwise(last["x"]), changed))
        return F.when(now.isNull(), s).otherwise(F.struct(now.alias("last"), F.array_append(s["out"], now).alias("out")))

    spells = rows.withColumn("spell", F.sum(entered.cast("int")).over(cum(keys)))
    whole = spells.groupBy(*keys, "spell").agg(F.sort_array(F.collect_list(facts)).alias("rows"))
    sizes = whole.select(*keys, F.inline(F.aggregate("rows", start, step)["out"])).select(*keys, "pos", F.struct("y", "x", "changed").alias("sized"))
    out = spells.join(sizes, [*keys, "pos"], "left")
    held = F.last("sized", ignorenulls=True).over(cum((*keys, "spell")))
    out = out.withColumn("_held", held).withColumn("rebalance", open_ & F.coalesce("sized.changed", F.lit(False)))
    for leg in "yx":
        out = out.withColumn(f"units_{leg}", F.when(open_, F.coalesce(f"_held.{leg}", f"units_{leg}")).otherwise(0.0))
    return mark(out.drop("_held", "sized", "spell"))

"""Spread standardisation, entry and exit rules, and the two trade state machines.

A machine is a fold (``aggregate``) over the sorted array of a key's rows that remembers row numbers, not counters, and
gives only the rows in which something happens.  States, holding periods and cooldowns of all rows are windows over these
events afterwards.  Open-loop fills fold over trades, not rows: each looks up the next row in which it can be filled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantmill.functions.folds import gathered, let
from quantmill.functions.windows import by, cum, poison, prior

PAIR = ("symbol_y", "symbol_x")
FLAT, LONG, SHORT = "FLAT", "LONG_SPREAD", "SHORT_SPREAD"
NONE, STOP, TIME, REVERT = "NONE", "STOP", "TIME", "MEAN_REVERSION"


def standardise(spreads: DataFrame, lookback: int = 60, keys: tuple = PAIR, ddof: int = 1) -> DataFrame:
    """rolling_mean, rolling_std and zscore from the ``lookback`` rows before each row.

    Any null among them makes all three null.  A std of 1e-12 or less is kept, and its z-score is null.
    """
    w, s = prior(keys, lookback), F.col("spread")
    spread_of = {1: F.stddev_samp, 0: F.stddev_pop}.get(ddof)
    std = poison(s, spread_of(s), w, lookback) if spread_of else poison(s, F.var_pop(s), w, lookback)
    std = std if spread_of else F.sqrt(std * lookback / (lookback - ddof))
    out = spreads.withColumn("rolling_mean", poison(s, F.avg(s), w, lookback)).withColumn("rolling_std", std)
    return out.withColumn("zscore", F.when(F.col("rolling_std") > 1e-12, (s - F.col("rolling_mean")) / F.col("rolling_std")))


def entry_rule(z: Column, entry: Column | float) -> Column:
    """LONG at z <= -entry, SHORT at z >= entry, else FLAT; null z enters nothing."""
    entry = F.lit(entry) if isinstance(entry, (int, float)) else entry
    return F.when(z <= -entry, LONG).when(z >= entry, SHORT).otherwise(FLAT)


def exit_rule(state: Column, z: Column, holding: Column, exit_z: float, stop_z: float, max_holding: int | None = None) -> Column:
    """Why an open state ends: STOP before TIME before MEAN_REVERSION, bounds inclusive, else NONE."""
    side = F.when(state == LONG, z).otherwise(-z)
    time = (holding >= max_holding) if max_holding is not None else F.lit(False)
    return F.when(side <= -stop_z, STOP).when(time, TIME).when(side >= -exit_z, REVERT).otherwise(NONE)


def invalid_thresholds(scenarios: DataFrame) -> DataFrame:
    """Scenarios whose thresholds contradict each other, with the first reason."""
    reason = F.when(F.col("exit_z") < 0, "exit_negative").when(F.col("entry_z") <= F.col("exit_z"), "entry_not_above_exit").when(F.col("stop_z") <= F.col("entry_z"), "stop_not_above_entry")
    return scenarios.withColumn("reason", reason).filter("reason is not null")


@dataclass
class Rules:
    """Thresholds of a run: numbers, or columns where each key (as a scenario) has its own."""

    entry: float | Column
    exit_: float | Column
    stop: float | Column
    max_holding: int | Column | None = None
    cooldown: int | Column | None = None

    def column(self) -> Column:
        put = lambda x, kind, name: (x if isinstance(x, Column) else F.lit(x)).cast(kind).alias(name)
        return F.struct(put(self.entry, "double", "entry"), put(self.exit_, "double", "exit"), put(self.stop, "double", "stop"), put(self.max_holding, "long", "longest"), F.coalesce(put(self.cooldown, "long", "cooldown"), F.lit(0).cast("long")).alias("cooldown"))


def _side(z: Column, rules: Column) -> Column:
    """1 where z calls for a long spread, -1 for a short one, 0 for none."""
    return F.when(z <= -rules["entry"], 1).when(z >= rules["entry"], -1).otherwise(0)


def _reason(side: Column, z: Column, held: Column, rules: Column) -> Column:
    """Why a position of this side ends, or null."""
    gain = z * side
    late = F.coalesce(held >= rules["longest"], F.lit(False))
    return F.when(gain <= -rules["stop"], STOP).when(late, TIME).when(gain >= -rules["exit"], REVERT)


def _ordered(rows: DataFrame, rules: Rules, keys: tuple, facts: tuple) -> DataFrame:
    """Per key the rules and its rows in order of ``pos``, as (at, *facts); ``at`` counts them from 0."""
    numbered = rows.select(*keys, rules.column().alias("rules"), (F.row_number().over(by(keys)) - 1).cast("long").alias("at"), *facts)
    return numbered.groupBy(*keys).agg(F.first("rules").alias("rules"), F.sort_array(F.collect_list(F.struct("at", *facts))).alias("rows"))


def _entry(side: Column) -> Column:
    return F.when(side == 1, "ENTER_LONG").otherwise("ENTER_SHORT")


def _name(side: Column) -> Column:
    return F.when(side == 1, LONG).when(side == -1, SHORT).otherwise(FLAT)


def _signal_columns(rows: DataFrame, keys: tuple, held: str) -> DataFrame:
    """The twelve signal columns from side (wanted), event and reason, and from the rows a position was opened and closed in.

    ``held`` names the side that is open, and ``before`` holds it for the row before.  A holding period counts rows
    since the position was opened, as long as it was open before the row; a cooldown counts the rows after it was
    closed in which none is open or wanted.
    """
    event, reason, w = F.coalesce("event", F.lit(NONE)), F.coalesce("reason", F.lit(NONE)), by(keys, "at")
    idle = ((F.col(held) == 0) & (F.col("side") == 0) & F.coalesce(F.col("at") != F.col("closed"), F.lit(True))).cast("long")
    rows = rows.withColumn("idle", F.coalesce(F.sum(idle).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = F.col("rules.cooldown") - F.col("idle") + F.last(F.when(F.col("at") == F.col("closed"), F.col("idle")), ignorenulls=True).over(cum(keys, "at"))
    return rows.select(
        "*", _name(F.col("side")).alias("state"), F.col("side").cast("byte").alias("position"), (event == "ENTER_LONG").alias("entry_long"), (event == "ENTER_SHORT").alias("entry_short"),
        (reason != NONE).alias("exit"), (reason == STOP).alias("stop"), (reason == TIME).alias("time_exit"), reason.alias("exit_reason"),
        F.when(F.col("before") != 0, F.col("at") - F.col("opened")).otherwise(0).cast("long").alias("holding_period"), F.greatest(F.coalesce(rest, F.lit(0)), F.lit(0)).cast("long").alias("cooldown_remaining"),
    ).withColumn("event", event)


SIGNALS = ("zscore", "state", "position", "entry_long", "entry_short", "exit", "stop", "time_exit", "event", "exit_reason", "holding_period", "cooldown_remaining")
EVENT = "struct<at:bigint,side:int,event:string,reason:string>"


def trade_signals(zscores: DataFrame, rules: Rules, keys: tuple = PAIR) -> DataFrame:
    """Desired trade states of every key: the twelve signal columns, by ``pos``.

    A flat key enters by the entry rule once ``cooldown`` rows have passed since its exit; an open one leaves by the
    exit rule from the row after its entry on.  An unknown z-score enters nothing and only time can end a position in it.
    """
    z = lambda r: r["zscore"]
    start = F.struct(F.lit(0).alias("side"), F.lit(None).cast("long").alias("since"))
    rule = F.col("rules")

    def change(state: Column, r: Column) -> Column:
        """What happens in a row, or null."""
        rested = state["since"].isNull() | (r["at"] > state["since"] + rule["cooldown"])
        entered = F.when((state["side"] == 0) & rested & (_side(z(r), rule) != 0), F.struct(r["at"].alias("at"), _side(z(r), rule).alias("side"), _entry(_side(z(r), rule)).alias("event"), F.lit(None).cast("string").alias("reason")))
        why = _reason(state["side"], z(r), r["at"] - state["since"], rule)
        left = F.when((state["side"] != 0) & why.isNotNull(), F.struct(r["at"].alias("at"), F.lit(0).alias("side"), F.concat(F.lit("EXIT_"), why).alias("event"), why.alias("reason")))
        return F.coalesce(entered, left)

    def step(state: Column, r: Column) -> Column:
        after = lambda e: F.struct(F.when(e.isNull(), state).otherwise(F.struct(e["side"].alias("side"), e["at"].alias("since"))).alias("state"), e.alias("made"))
        return let(change(state, r), after)

    events = _ordered(zscores, rules, keys, ("zscore",)).select(*keys, F.inline(gathered(F.col("rows"), start, step, EVENT))).select(*keys, "at", F.col("side").alias("to"), "event", "reason")
    rows = zscores.select(*keys, "pos", "zscore", rules.column().alias("rules"), (F.row_number().over(by(keys)) - 1).cast("long").alias("at"))
    rows, w = rows.join(events, [*keys, "at"], "left"), cum(keys, "at")
    rows = rows.withColumn("side", F.coalesce(F.last("to", ignorenulls=True).over(w), F.lit(0)))
    rows = rows.withColumn("opened", F.last(F.when(F.col("to") != 0, F.col("at")), ignorenulls=True).over(w)).withColumn("closed", F.last(F.when(F.col("to") == 0, F.col("at")), ignorenulls=True).over(w))
    rows = rows.withColumn("before", F.coalesce(F.lag("side").over(by(keys, "at")), F.lit(0)))
    return _signal_columns(rows, keys, "side").select(*keys, "pos", *SIGNALS)


ORDER = "struct<side:int,event:string,at:bigint>"
FILLED = "struct<at:bigint,side:int,event:string,reason:string,fill:string,now:int,source:bigint>"


def filled_signals(rows: DataFrame, rules: Rules, lag: int = 1, suppress_last: bool = False, keys: tuple = PAIR) -> DataFrame:
    """Fill-aware trade states: signal columns, executed_state, execution_event and the rows they were decided and due.

    ``rows`` has zscore, tradable (both prices observed) and sized (hedge ratio known).  A decision falls due ``lag``
    rows later and becomes the order that waits; it is filled in the first row that is tradable (and sized, for an
    entry).  A close that falls due while nothing is open calls the waiting entry off; one that waits already stays.
    An entry that falls due while a close waits comes after it, unless another close falls due before.
    Holding counts from the entry's fill and cooldown from the exit's; the row of an exit's fill decides nothing; an
    entry that waits can be called off by mean reversion.  ``suppress_last``: no entry is filled in a key's last row.
    """
    facts, rule, end = ("zscore", "tradable", "sized"), F.col("rules"), F.size("rows") - 1
    null = lambda kind: F.lit(None).cast(kind)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("want"), null("long").alias("opened"), null("long").alias("closed"), F.lit(0).cast("long").alias("idle"), null(ORDER).alias("waits"), null(ORDER).alias("then"), F.array().cast(f"array<{ORDER}>").alias("coming"))

    def waiting(s: Column, r: Column) -> Column:
        """The order that waits, and one after it, once what falls due in this row has joined them."""
        due = F.get(F.filter(s["coming"], lambda x: x["at"] + lag == r["at"]), F.lit(0))
        close_waits = F.coalesce(s["waits"]["side"] == 0, F.lit(False))
        first = lambda d: F.when(d.isNull() | ((d["side"] != 0) & close_waits), s["waits"]).when(d["side"] != 0, d).when(s["now"] == 0, null(ORDER)).when(close_waits, s["waits"]).otherwise(d)
        second = lambda d: F.when(d.isNull(), s["then"]).when((d["side"] != 0) & close_waits, d)
        return let(due, lambda d: F.struct(first(d).alias("first"), second(d).alias("second")))

    def filled(s: Column, r: Column, order: Column) -> Column:
        late = F.lit(suppress_last) & (r["at"] == end) & (s["now"] == 0)
        return order.isNotNull() & r["tradable"] & (r["sized"] | (order["side"] == 0)) & ~late

    def decide(s: Column, r: Column, now: Column, opened: Column, closed: Column) -> Column:
        """The order decided in a row whose fill is known, with its reason in ``event``; null if there is none."""
        order = lambda side, event: F.struct(side.cast("int").alias("side"), event.alias("event"), r["at"].alias("at"))
        z, leaving = r["zscore"], closed == r["at"]
        why = F.when((now != 0) & (s["want"] == now), _reason(now, z, r["at"] - opened, rule)).when((now == 0) & (s["want"] != 0) & (z * s["want"] >= -rule["exit"]), REVERT)
        enters = (now == 0) & (s["want"] == 0) & (_side(z, rule) != 0) & (closed.isNull() | (s["idle"] >= rule["cooldown"]))
        return F.when(F.coalesce(leaving, F.lit(False)), null(ORDER)).when(why.isNotNull(), order(F.lit(0), why)).when(enters, order(_side(z, rule), _entry(_side(z, rule))))

    def step(s: Column, r: Column) -> Column:
        def with_fill(x: Column) -> Column:
            order, fills = x["order"]["first"], x["fills"]
            now = F.when(fills, order["side"]).otherwise(s["now"])
            opened = F.when(fills & (order["side"] != 0), r["at"]).otherwise(s["opened"])
            closed = F.when(fills & (order["side"] == 0), r["at"]).otherwise(s["closed"])
            return let(F.struct(now.alias("now"), opened.alias("opened"), closed.alias("closed")), lambda y: let(decide(s, r, y["now"], y["opened"], y["closed"]), lambda d: after(x["order"], fills, y, d)))

        def after(orders: Column, fills: Column, y: Column, d: Column) -> Column:
            order, want = orders["first"], F.when(d.isNull(), s["want"]).otherwise(d["side"])
            closes = F.coalesce(y["closed"] == r["at"], F.lit(False))
            idle = F.when(closes, 0).when((y["now"] == 0) & (want == 0), s["idle"] + 1).otherwise(s["idle"])
            leaves = d["side"] == 0
            named = F.when(leaves, F.concat(F.lit("EXIT_"), d["event"])).otherwise(d["event"])
            made = F.struct(d["side"].alias("side"), named.alias("event"), d["at"].alias("at"))
            happened = F.struct(r["at"].alias("at"), d["side"].alias("side"), named.alias("event"), F.when(leaves, d["event"]).alias("reason"), F.when(fills, order["event"]).alias("fill"), F.when(fills, order["side"]).alias("now"), F.when(fills, order["at"]).alias("source"))
            late = F.filter(s["coming"], lambda c: c["at"] + lag > r["at"])
            state = F.struct(
                y["now"].alias("now"), want.alias("want"), y["opened"].alias("opened"), y["closed"].alias("closed"), idle.cast("long").alias("idle"),
                F.when(fills, orders["second"]).otherwise(order).alias("waits"), F.when(~fills, orders["second"]).alias("then"), F.when(d.isNull(), late).otherwise(F.array_append(late, made)).alias("coming"),
            )
            return F.struct(state.alias("state"), F.when(d.isNotNull() | fills, happened).alias("made"))

        return let(waiting(s, r), lambda order: let(F.struct(order.alias("order"), F.coalesce(filled(s, r, order["first"]), F.lit(False)).alias("fills")), with_fill))

    known = rows.withColumn("tradable", F.coalesce("tradable", F.lit(False))).withColumn("sized", F.coalesce("sized", F.lit(False)))
    events = _ordered(known, rules, keys, facts).select(*keys, F.inline(gathered(F.col("rows"), start, step, FILLED))).withColumnsRenamed({"side": "to", "now": "became"})
    out = known.select(*keys, "pos", "zscore", rules.column().alias("rules"), (F.row_number().over(by(keys)) - 1).cast("long").alias("at"))
    out = _executed(out.join(events, [*keys, "at"], "left"), keys, lag)
    out = out.withColumn("side", F.coalesce(F.last("to", ignorenulls=True).over(cum(keys, "at")), F.lit(0)))
    return _signal_columns(out, keys, "actual").select(*keys, "pos", *SIGNALS, *EXECUTION)


EXECUTION = ("executed_state", "execution_event", "execution_decision_row", "execution_due_row")


def _executed(rows: DataFrame, keys: tuple, lag: int) -> DataFrame:
    """EXECUTION, and actual, before, opened and closed, from what fills (fill, became, source) have made of each row."""
    w = cum(keys, "at")
    rows = rows.withColumn("actual", F.coalesce(F.last("became", ignorenulls=True).over(w), F.lit(0)))
    rows = rows.withColumn("opened", F.last(F.when(F.col("became") != 0, F.col("at")), ignorenulls=True).over(w)).withColumn("closed", F.last(F.when(F.col("became") == 0, F.col("at")), ignorenulls=True).over(w))
    rows = rows.withColumn("before", F.coalesce(F.lag("actual").over(by(keys, "at")), F.lit(0)))
    return rows.select("*", _name(F.col("actual")).alias("executed_state"), F.coalesce("fill", F.lit(NONE)).alias("execution_event"), F.col("source").alias("execution_decision_row"), (F.col("source") + lag).alias("execution_due_row"))


def open_loop_fills(signals: DataFrame, lag: int = 1, suppress_last: bool = False, keys: tuple = PAIR) -> DataFrame:
    """Fills of a supplied signal table (event, tradable, sized): executed_state and execution_event by ``pos``.

    A trade is an entry and the next exit decided after it.  Its entry is filled in the first row, from the one it
    falls due in and after the last trade's close, that is tradable and sized; not at all if its exit falls due by
    then.  Its exit is filled in the first tradable row from the one it falls due in.
    """
    ahead = Window.partitionBy(*keys).orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    rows = signals.select(*keys, "pos", "event", "tradable", "sized", (F.row_number().over(by(keys)) - 1).cast("long").alias("at"))
    exits = F.when(F.col("event").startswith("EXIT"), F.struct("at", "event"))
    full = rows.select("*", F.min(F.when(F.col("tradable") & F.col("sized"), F.col("at"))).over(ahead).alias("enter"), F.min(F.when(F.col("tradable"), F.col("at"))).over(ahead).alias("leave"), F.min(exits).over(ahead).alias("exit"))
    trade = F.when(F.col("event").startswith("ENTER"), F.struct("at", "event", "exit"))
    whole = full.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "enter", "leave"))).alias("next"), F.sort_array(F.collect_list(trade)).alias("trades"))
    start = F.struct(F.lit(-1).cast("long").alias("closed"))
    size = F.size("next").cast("long")
    when = lambda at, what: F.get(F.col("next"), at.cast("int"))[what]

    def step(s: Column, t: Column) -> Column:
        def one(x: Column) -> Column:
            off = x["in"].isNull() | F.coalesce(t["exit"]["at"] + lag <= x["in"], F.lit(False)) | (F.lit(suppress_last) & (x["in"] == size - 1))
            side = F.when(t["event"] == "ENTER_LONG", 1).otherwise(-1)
            fill = lambda at, event, became, source: F.struct(at.alias("at"), event.alias("fill"), became.alias("became"), source.alias("source"))
            entry, leave = fill(x["in"], t["event"], side, t["at"]), fill(x["out"], t["exit"]["event"], F.lit(0), t["exit"]["at"])
            more = F.when(x["out"].isNull(), F.array(entry)).otherwise(F.array(entry, leave))
            return F.struct(F.when(off, s).otherwise(F.struct(F.coalesce(x["out"], size).alias("closed"))).alias("state"), F.when(~off, more).alias("made"))

        return let(F.struct(when(F.greatest(t["at"] + lag, s["closed"] + 1), "enter").alias("in"), when(t["exit"]["at"] + lag, "leave").alias("out")), one)

    events = whole.select(*keys, F.inline(F.flatten(gathered(F.col("trades"), start, step, "array<struct<at:bigint,fill:string,became:int,source:bigint>>"))))
    return _executed(rows.join(events, [*keys, "at"], "left"), keys, lag).select(*keys, "pos", *EXECUTION)

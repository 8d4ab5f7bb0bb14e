"""Candidate pairs, pair panels, folds and the joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["symbol_y", "symbol_x"]
#: Row positions that in_fold takes together.
BLOCK = 256


def candidate_pairs(universe: DataFrame) -> DataFrame:
    """Unordered pairs of symbols within a group (a null group is a group), symbol_y < symbol_x.

    The number of rows is the answer itself, S(S-1)/2 a group; group keys make it an equi-join.
    """
    a = universe.select(F.col("symbol").alias("symbol_y"), F.col("group_name").alias("g"))
    b = universe.select(F.col("symbol").alias("symbol_x"), F.col("group_name").alias("group_name"))
    return a.join(b, F.col("g").eqNullSafe(F.col("group_name")) & (F.col("symbol_y") < F.col("symbol_x"))).select(*PAIR, "group_name")


def pair_panel(pairs: DataFrame, prices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both legs' prices on the dates that both have, with ``pos`` by date; further columns of ``pairs`` stay.

    ``keys`` name what numbers rows besides the pair.
    """
    keys = keys or []
    leg = lambda s: prices.select(F.col("symbol").alias(f"symbol_{s}"), "date", F.col("price").alias(f"price_{s}"), *([F.col("observed").alias(f"observed_{s}")] if "observed" in prices.columns else []))
    both = pairs.join(leg("y"), "symbol_y").join(leg("x"), ["symbol_x", "date"]).filter("price_y is not null and price_x is not null")
    return both.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys, *PAIR).orderBy("date")) - 1).cast("long"))


def folds(rows: DataFrame, formation: int, trading: int, step: int | None = None, expanding: bool = False) -> DataFrame:
    """Walk-forward folds over ``rows`` (one row: n, the number of row positions); an incomplete tail is dropped."""
    step = step or trading
    n = F.col("n").cast("long")
    start = F.when(n >= formation + trading, F.sequence(F.lit(0).cast("long"), n - formation - trading, F.lit(step).cast("long")))
    out = rows.select("*", F.posexplode(start).alias("fold_id", "at")).drop("n")
    first = F.lit(0).cast("long") if expanding else F.col("at")
    return out.select(*[c for c in out.columns if c not in ("fold_id", "at")], F.col("fold_id").cast("long"), first.alias("formation_start_pos"), (F.col("at") + formation - 1).alias("formation_end_pos"), (F.col("at") + formation).alias("trading_start_pos"), (F.col("at") + formation + trading - 1).alias("trading_end_pos"))


def in_fold(rows: DataFrame, fold_table: DataFrame, part: str = "all") -> DataFrame:
    """Rows with the folds whose formation, trading or whole range holds their ``pos``.

    A row meets its folds by blocks of positions, an equi-join, so folds may be as many as scenarios make them.
    """
    a, b = {"formation": ("formation_start_pos", "formation_end_pos"), "trading": ("trading_start_pos", "trading_end_pos"), "all": ("formation_start_pos", "trading_end_pos")}[part]
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spread = fold_table.withColumn("_block", F.explode(F.sequence(block(a), block(b))))
    return rows.withColumn("_block", block("pos")).join(spread, "_block").filter(F.col("pos").between(F.col(a), F.col(b))).drop("_block")


def next_fillable(rows: DataFrame, keys: list[str], fillable) -> DataFrame:
    """``next_pos``: the first row at or after each row in which an order can be filled."""
    ahead = Window.partitionBy(*keys).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("next_pos", F.min(F.when(fillable, F.col("pos"))).over(ahead))


def common_labels(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """Labels that every entity has: the intersection over entities, whatever their values."""
    total = rows.select(F.countDistinct(entity).alias("total"))
    per = rows.groupBy(label).agg(F.countDistinct(entity).alias("n"))
    return per.join(F.broadcast(total), F.col("n") == F.col("total")).select(label)


def misaligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, with the side that has them."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, keys, "full").filter("_l is null or _r is null")
    return both.select(*keys, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))

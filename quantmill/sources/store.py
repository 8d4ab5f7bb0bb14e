"""Stored screening results, quality reports and the run registry, as tables of files; and reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.sources.prices import upsert


def store_screening(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert on (run_id, y, x); an infinite half-life is stored as null with a flag."""
    infinite = F.col("half_life") == float("inf")
    batch = batch.withColumn("half_life_was_infinite", F.coalesce(infinite, F.lit(False))).withColumn("half_life", F.when(~infinite, F.col("half_life")))
    return upsert(existing, batch, ["run_id", "symbol_y", "symbol_x"], "loaded_at")


def load_screening(stored: DataFrame, run_id: str | None = None, selected_only: bool = False, max_rank: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a run, selected first, then by rank, corrected p (nulls last) and pair; infinite half-lives restored."""
    rows = stored.filter(F.col("run_id") == run_id) if run_id is not None else stored
    rows = rows.filter("selected") if selected_only else rows
    rows = rows.filter(F.col("rank") <= max_rank) if max_rank is not None else rows
    rows = rows.withColumn("half_life", F.when(F.col("half_life_was_infinite"), F.lit(float("inf"))).otherwise(F.col("half_life")))
    rows = rows.orderBy(F.col("selected").desc(), F.col("rank").asc_nulls_last(), F.col("corrected_p").asc_nulls_last(), "symbol_y", "symbol_x")
    return rows.limit(limit) if limit is not None else rows


def new_runs(runs: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose run_id is not stored yet: the ones that may be appended."""
    return batch.join(runs.select("run_id"), "run_id", "left_anti")


def list_runs(identities: DataFrame, summaries: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = identities.join(summaries, "run_id").orderBy(F.col("created_at").desc(), "run_id")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def selection_by_group(stored: DataFrame) -> DataFrame:
    return stored.groupBy("group_name").agg(F.count("*").alias("pairs"), F.count_if("selected").alias("selected"), (F.count_if("selected") / F.count("*")).alias("selection_rate"))


def most_selected(stored: DataFrame) -> DataFrame:
    return stored.filter("selected").groupBy("symbol_y", "symbol_x").agg(F.count_distinct("run_id").alias("runs"))


def mean_diagnostics(stored: DataFrame) -> DataFrame:
    return stored.filter("selected").groupBy("symbol_y", "symbol_x").agg(F.avg("corrected_p").alias("mean_p"), F.avg("half_life").alias("mean_half_life"), F.avg("hurst").alias("mean_hurst"), F.count("*").alias("n"))


def rejection_counts(stored: DataFrame) -> DataFrame:
    """Pairs by rejection reason; ``rejection_reasons`` is a JSON text."""
    return stored.select(F.explode(F.from_json("rejection_reasons", "array<string>")).alias("reason")).groupBy("reason").agg(F.count("*").alias("pairs"))


def run_summary(stored: DataFrame) -> DataFrame:
    chosen = F.col("selected")
    return stored.groupBy("run_id").agg(F.count("*").alias("pairs"), F.count_if(chosen).alias("selected"), F.avg(F.when(chosen, F.col("corrected_p"))).alias("mean_p"), F.median(F.when(chosen, F.col("half_life"))).alias("median_half_life"), F.max("rank").alias("worst_rank"))

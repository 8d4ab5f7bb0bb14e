"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

The order of a source's documents is that of md5(seed, doc_id).  Its first hex digits deal a source into 4096 cells,
so even a source with a third of all rows is spread; the cells' sums give each cell its offset, and a running sum
inside a cell does the rest.  Only per-source and per-cell sums are looked at as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantmill.llm.text import packed, split_words, unpacked, whole

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"
RESULT = ("size", "source_size", "target", "epochs", "part", "taken")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (_s, source_size; one row per source) with target, epochs and rest.

    ``_s`` orders sources by code point, null last; in this order they get the weights in turn.  Targets are min(cap, rate * weight) with one rate for
    all, which is where resharing the excess by weight ends.  The rate follows from the sources in order of cap per
    weight: those before the first whose cap is not reached are capped.  One row per source is all that is ordered.
    """
    every = Window.orderBy("_s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "_s")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("rate", (total - before) / heavier)
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rate"))
    out = out.withColumn("rate", F.min(fits).over(Window.partitionBy())["rate"])
    out = out.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap").cast("double"))))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("cap"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return out.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - epochs * F.col("source_size")).cast("long")).select("_s", "source_size", "target", "epochs", "rest")


def _mixed(docs: DataFrame, weights: tuple, max_repeats: int, seed: str) -> DataFrame:
    """``row`` (the columns of docs) with the columns of RESULT."""
    docs = packed(docs)
    docs = docs.withColumn("_s", F.coalesce(F.concat(F.lit("0"), F.col("row.source").cast("string")), F.lit("1"))).withColumn("size", F.size(split_words(whole(F.col("row.text")))).cast("long"))
    docs = docs.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col("row.doc_id").cast("string"))))
    docs = docs.withColumn("_cell", F.substring("_key", 1, 3))
    cells = docs.groupBy("_s", "_cell").agg(F.sum("size").alias("_size"))
    aims = targets(cells.groupBy("_s").agg(F.sum("_size").alias("source_size")), weights, max_repeats)
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).join(aims, "_s").drop("_size")
    inside = Window.partitionBy("_s", "_cell").orderBy("_key", "row.doc_id", F.xxhash64("row.text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_upto", F.sum("size").over(inside))
    docs = docs.join(cells, ["_s", "_cell"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("_before") + F.col("_upto") - F.col("size"))))
    docs = docs.withColumn("part", part.cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    return docs.select("row", *RESULT)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs`` with size (words), source_size, target, epochs, part and taken = epochs * size + part.

    Every row stays, with taken 0 if the mix does not take it.  ``part`` is what the last, unfinished epoch takes of
    it: all, nothing, or for one document of a source its first words.  A null source is a source; null texts have
    size 0, texts of any length their number of words.  Documents of one key are taken by id, then by text; rows that
    repeat an id and a text may swap places, which changes nothing.  Columns of ``docs`` that have these six names
    are replaced, all others stay.
    """
    return _mixed(docs, weights, max_repeats, seed).select(*unpacked([c for c in docs.columns if c not in RESULT]), *RESULT)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, columns as they were.

    The document at a source's cut comes whole if half of its words or more are inside the budget.
    """
    copies = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = _mixed(docs, weights, max_repeats, seed).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*unpacked(docs.columns))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; odd rows as in mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || doc_id::VARCHAR) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM w
), f AS (
  SELECT *, (SELECT arg_min(rate, cap / weight) FROM r WHERE rate * weight <= cap) AS final FROM r
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, final * weight) AS target FROM f
), b AS (
  SELECT *, least(floor(target + 0.5)::BIGINT, source_size * 3) AS budget FROM t
), o AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs, b.budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM o
"""

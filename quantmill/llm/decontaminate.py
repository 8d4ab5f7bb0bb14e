"""Benchmark decontamination: windows of normalised benchmark words against every window of every document.

The benchmark's windows become a hash table of a fixed number of slots, sent to the tasks as a literal, so that a
document never leaves its row or its partition.  Only a benchmark of at most ``max_windows`` distinct windows is
sent (they are counted first).  Of a larger one the windows' hashes are sent, up to MAX_HASHES (a larger set of them is
shuffled): places of documents whose hash is among them are kept, and these few are compared by their words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.llm.shared import sent, written
from quantmill.llm.text import NOT_ALNUM, ascii_lower, digest, let, packed, split_words, unpacked, whole

WINDOW = 13
SLOTS = 1 << 16
MAX_WINDOWS = 50_000
#: Hashes of windows that are sent: 10 million take about 160 MB.
MAX_HASHES = 10_000_000
#: Documents with a place that may be a hit: so many are sent to the texts, more are shuffled with them.
FEW = 1 << 18
HITS = "array<struct<at:int,length:int,items:array<string>>>"
OWN = ("_w", "_found", "_row")


def normal_words(text: Column) -> Column:
    return split_words(ascii_lower(whole(text)), NOT_ALNUM)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: length, gram (its words, space-joined), w (them as an array), items (sorted ids as strings).

    Items without words have no window; equal windows of several items are one row.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("length"))
    items = items.select("item", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    items = items.select("item", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("gram"), F.slice("w", F.col("at"), F.col("length")).alias("w"))
    grams = items.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("w").alias("w"))
    return grams.select("length", "gram", "items", "w")


def _slot(words: Column, at, length) -> Column:
    """The slot of a window, by its first words, three at most: so windows of three or more words need one look-up."""
    return F.pmod(F.xxhash64(*[F.get(words, at + k) for k in range(min(3, length))]), F.lit(SLOTS)).cast("int")


def _table(windows: DataFrame, lengths: list[int]) -> tuple[Column, Column]:
    """Whether a slot is taken, and the windows by slot.  Called for a counted, bounded number of windows only."""
    slots: list = [None] * SLOTS
    slot = F.coalesce(*[F.when(F.col("length") == k, _slot(F.col("w"), F.lit(0), k)) for k in lengths])
    for r in windows.select(slot.alias("slot"), "length", "gram", "items").collect():
        slots[r["slot"]] = [*(slots[r["slot"]] or []), {"length": r["length"], "gram": r["gram"], "items": r["items"]}]
    taken = F.from_json(F.lit(json.dumps([int(x is not None) for x in slots], separators=(",", ":"))), "array<tinyint>")
    return taken, F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<array<struct<length:int,gram:string,items:array<string>>>>")


def _places(w: Column, lengths: list[int], taken) -> Column:
    """Array of (at, length) of a document's windows whose first words have a slot for which ``taken(slot)`` holds."""
    n, none = F.size(w), F.array().cast("array<struct<at:int,length:int>>")

    def of(some: list[int]) -> Column:
        at = F.filter(F.sequence(F.lit(0), n - some[0]), lambda i: taken(_slot(w, i, some[0])))
        each = lambda i: F.array(*[F.struct(i.alias("at"), F.lit(k).alias("length")) for k in some])
        return F.when(n >= some[0], F.filter(F.flatten(F.transform(at, each)), lambda x: x["at"] + x["length"] <= n)).otherwise(none)

    groups = [[k] for k in lengths if k < 3] + [[k for k in lengths if k >= 3]]
    return F.concat(none, *[of(g) for g in groups if g])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words and hits: array of (at, length, items), the document's windows that are the benchmark's.

    Repeated rows, null ids and null texts (no words) stay as rows.  An empty benchmark gives no hits.  Texts of any
    length are searched as a whole; windows that several items share (ties) name all of them.  Columns of ``docs``
    called n_words, hits, _w, _found or _row are replaced; decontaminate() keeps them.
    """
    docs = docs.drop("n_words", "hits", *OWN)
    words = normal_words(F.col("text"))
    windows = benchmark_windows(benchmark, window)
    found = windows.groupBy("length").count().collect()  # at most one row per length up to ``window``
    lengths, total = sorted(r["length"] for r in found), sum(r["count"] for r in found)
    if not lengths:
        return docs.withColumn("n_words", F.size(words).cast("long")).withColumn("hits", F.array().cast(HITS))
    if total <= max_windows:
        taken, table = _table(windows, lengths)

        def verified(w: Column) -> Column:
            own = lambda x: F.coalesce(*[F.when(x["length"] == k, F.get(table, _slot(w, x["at"], k))) for k in lengths])
            whose = lambda x: F.get(F.filter(own(x), lambda y: (y["length"] == x["length"]) & (y["gram"] == gram(w, x))), 0)["items"]
            at = _places(w, lengths, lambda slot: F.get(taken, slot) == 1)
            hits = F.transform(at, lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"), whose(x).alias("items")))
            return F.struct(F.size(w).cast("long").alias("n_words"), F.filter(hits, lambda x: x["items"].isNotNull()).alias("hits"))

        docs = docs.withColumn("_found", let(words, verified))
        return docs.withColumn("n_words", F.col("_found.n_words")).withColumn("hits", F.col("_found.hits")).drop("_found")
    return _joined(docs.withColumn("_w", words).withColumn("n_words", F.size("_w").cast("long")), windows, lengths, total)


def gram(words: Column, x: Column) -> Column:
    return F.array_join(F.transform(F.sequence(x["at"], x["at"] + x["length"] - 1), lambda i: F.get(words, i)), " ")


def _hash(words: Column, at, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def _joined(docs: DataFrame, windows: DataFrame, lengths: list[int], total: int) -> DataFrame:
    """For a benchmark whose words are too many to send: hashes find the places, words verify them; hits return by content digest."""
    docs = docs.withColumn("_row", F.when(F.size("_w") > 0, digest(F.array_join("_w", " "))))  # null meets nothing, and is spread
    hashes = windows.select("length", F.coalesce(*[F.when(F.col("length") == k, _hash(F.col("w"), F.lit(0), k)) for k in lengths]).alias("hash")).distinct()
    hashes = F.broadcast(hashes) if total <= MAX_HASHES else hashes
    n, none = F.size("_w"), F.array().cast("array<struct<at:int,length:int,hash:bigint>>")

    def places(k: int) -> Column:
        one = lambda i: F.struct(i.alias("at"), F.lit(k).alias("length"), _hash(F.col("_w"), i, k).alias("hash"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(none)

    at = docs.filter("_row is not null").select("_row", F.explode_outer(F.concat(none, *map(places, lengths))).alias("x")).select("_row", "x.at", "x.length", "x.hash")
    met = at.join(hashes, ["length", "hash"]).groupBy("_row").agg(F.collect_set(F.struct("at", "length")).alias("places"))
    words = docs.join(sent(written(met), FEW), "_row").select("_row", "_w", F.explode("places").alias("x")).select("_row", "x.at", "x.length", gram(F.col("_w"), F.col("x")).alias("gram"))
    hits = words.join(windows.drop("w"), ["length", "gram"]).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("at", "length", "items"))).alias("hits"))
    return docs.join(sent(written(hits), FEW), "_row", "left").withColumn("hits", F.coalesce("hits", F.array().cast(HITS))).drop("_row", "_w")


def judge(found: DataFrame) -> DataFrame:
    """Adds n_hit (words inside hits), items (sorted), contaminated (a twentieth of the words or more are hit)."""
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    found = found.withColumn("n_hit", F.size(inside).cast("long")).withColumn("items", items)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without the contaminated documents; all columns, whatever their names, as they were."""
    rows = packed(docs).withColumn("text", F.col("row.text"))
    return judge(find_hits(rows, benchmark, window, max_windows)).filter(~F.col("contaminated")).select(*unpacked(docs.columns))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark passages; odd rows as in find_hits()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

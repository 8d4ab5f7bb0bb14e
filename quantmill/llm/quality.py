"""Quality rules: signals of each document alone, and lines that too many documents of a host share.

Everything here is DataFrame expressions.  The signals need no shuffle.  For the lines, one row per line
(host, hash, content digest, characters) is shuffled, never a text, and counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.llm.text import digest, has_word, let, split_words, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host when more documents of different content have it than this share of the host's, and
#: than this number, which matters for small hosts alone.
LINE_SHARE = 0.01
LINE_FLOOR = 10
#: A document is depleted when boilerplate lines hold more than this share of its characters.
DEPLETED_SHARE = 0.7
#: Above this share it is depleted, too, if fewer than MIN_WORDS words are left (in proportion to characters).
THINNED_SHARE = 0.25
SYMBOLS = r"[#*$%&|<>]+"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: sort windows by hash, look at both neighbours."""

    def covered(dealt: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(dealt, other)["h"] == x["h"], F.lit(False))
        twice = F.filter(dealt, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

    def repeated(windows: Column) -> Column:
        dealt = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(dealt, covered))

    def windows(w: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) >= 3, let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window), repeated)).otherwise(0)

    return let(words, windows)


def _rated(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of docs but text), ``raw`` (the text) and the columns of SIGNALS.

    Texts stay outside of the row: where no result needs them after a join, they are not shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    docs = docs.select(row.alias("row"), F.col("text").alias("raw")).withColumn("whole", whole(F.col("raw")))
    docs = docs.withColumn("words", split_words(F.col("whole")))
    docs = docs.withColumn("n_words", F.size("words").cast("long")).withColumn("n_repeat_words", _repeat_words(F.col("words")).cast("long"))
    docs = docs.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
    docs = docs.withColumn("n_symbols", (F.char_length("whole") - F.char_length(F.regexp_replace("whole", SYMBOLS, ""))).cast("long"))
    docs = docs.withColumn("lines", F.filter(F.split("whole", "\n"), has_word)).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed).select("row", "raw", *SIGNALS)


def _own(names: list[str]) -> list[Column]:
    """The caller's columns of these names."""
    return [F.col("raw").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]


def signals(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts have no words and fail.  Texts of any length are read as a whole.  Columns of ``docs`` that
    have these six names are replaced, all others stay.
    """
    return _rated(docs).select(*_own([c for c in docs.columns if c not in SIGNALS]), *SIGNALS)


def line_key(line: Column) -> Column:
    """Hash of a normalised line: case, and blanks around it, do not matter."""
    return F.xxhash64(F.lower(F.trim(line)))


def shared_lines(docs: DataFrame, host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR) -> DataFrame:
    """One row per (host, digest) of texts with boilerplate lines: line_chars, shared_chars and hashes of the lines to remove.

    A line counts once for each different text of a host, so exact copies do not make it common.  It is boilerplate
    when more than ``line_share`` of the host's different texts have it, and more than ``line_floor``.  The first
    document (lowest doc_id, then digest) that has a common line keeps it, so no content disappears from a host
    entirely.  A null host is a host.  Characters are summed over copies, which leaves their ratio as it is.
    """
    text = whole(F.col("text"))
    rows = docs.select(F.col(f"`{host}`").alias("host"), digest(text).alias("digest"), "doc_id", F.split(text, "\n").alias("x"))  # below the explode: once a text
    sizes = rows.groupBy("host", "digest").agg(F.first(F.lit(1)).alias("one")).groupBy("host").agg(F.greatest(F.count("*") * line_share, F.lit(float(line_floor))).alias("limit"))
    rows = rows.withColumn("x", F.explode_outer("x")).filter(has_word(F.col("x")))
    rows = rows.select("host", "digest", "doc_id", line_key(F.col("x")).alias("line"), F.char_length("x").alias("chars"))
    rows = rows.groupBy("host", "digest", "line").agg(F.sum("chars").alias("chars"), F.min("doc_id").alias("first"))
    # Both uses of rows keep all its columns: then Spark runs it, and its shuffle, once.
    common = rows.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct("first", "digest")).alias("keeper"), F.max("chars").alias("most"))
    common = common.filter((F.col("n") > line_floor) & (F.col("most") > 0)).select(F.col("host").alias("h"), F.col("line").alias("l"), "keeper", "n")
    common = common.join(sizes, F.col("h").eqNullSafe(F.col("host"))).filter("n > limit").select("h", "l", "keeper")
    met = rows.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left")
    gone = F.col("l").isNotNull() & ~F.struct("first", "digest").eqNullSafe(F.col("keeper"))
    met = met.groupBy("host", "digest").agg(F.sum("chars").alias("line_chars"), F.sum(F.when(gone, F.col("chars")).otherwise(0)).alias("shared_chars"), F.collect_list(F.when(gone, F.col("line"))).alias("shared"))
    return met.filter("shared_chars > 0")


def _judged(docs: DataFrame, host: str, line_share: float, line_floor: int, depleted_share: float) -> DataFrame:
    """What _rated() gives, with shared_share, kept and clean_text."""
    rated = _rated(docs).withColumn("h", F.col(f"row.`{host}`")).withColumn("d", digest(whole(F.col("raw"))))
    common = shared_lines(docs, host, line_share, line_floor)
    out = rated.join(common, F.col("h").eqNullSafe(F.col("host")) & (F.col("d") == F.col("digest")), "left")
    out = out.withColumn("shared_share", F.coalesce(F.col("shared_chars") / F.col("line_chars"), F.lit(0.0)))
    left = F.filter(F.split("raw", "\n"), lambda x: ~F.array_contains("shared", line_key(x)))
    out = out.withColumn("clean_text", F.when(F.col("shared_chars") > 0, F.array_join(left, "\n")).otherwise(F.col("raw")))
    left_words = F.col("n_words") * (1 - F.col("shared_share"))  # in proportion: what is left of a text need not travel to be counted
    thin = (F.col("shared_share") > THINNED_SHARE) & (left_words < MIN_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("shared_share") <= depleted_share) & ~thin)


def apply_rules(docs: DataFrame, host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, depleted_share: float = DEPLETED_SHARE) -> DataFrame:
    """``docs`` with the signals, shared_share, kept and clean_text (the text without boilerplate lines).

    A document is rejected (kept is false) if its signals fail, if boilerplate lines, as shared_lines() has them, hold
    more than ``depleted_share`` of the characters of its lines, or if they hold more than THINNED_SHARE and the
    same share of its words leaves fewer than MIN_WORDS.  Every row of ``docs`` gives one row, repeated rows
    and null ids too.  Columns of ``docs`` that have the names of these results are replaced, all others stay.
    """
    results = (*SIGNALS, "shared_share", "kept", "clean_text")
    return _judged(docs, host, line_share, line_floor, depleted_share).select(*_own([c for c in docs.columns if c not in results]), *results)


def kept_documents(docs: DataFrame, host: str = "source", line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR, depleted_share: float = DEPLETED_SHARE) -> DataFrame:
    """The documents that are not rejected, with clean texts; n_chars follows the text, all other columns stay."""
    out = _judged(docs, host, line_share, line_floor, depleted_share).filter("kept")
    clean = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return out.select(*[clean[c].alias(c) if c in clean else x for c, x in zip(docs.columns, _own(docs.columns), strict=True)])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its signals and whether the rules keep it; odd rows as in apply_rules()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "shared_share")

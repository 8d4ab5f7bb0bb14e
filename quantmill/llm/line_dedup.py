"""Near-duplicate lines by a segment-partition edit join.

Two lines (lower-cased, trimmed) are near when their edit distance is at most allowed(length of the shorter): one edit
for SHORT characters, two for twice as many and more.  So lines under SHORT characters are near only if equal: a list or
code keeps its short lines.

The shorter of two near lines is cut into EDITS + 1 segments, and at least one of them stands unchanged in the longer
one, shifted by no more than the edits allow.  So each line gives its segments as index keys, and the substrings at the
shifts that are possible for each length as probe keys; a key is a hash of (length, segment number, characters), made
by column expressions, so a key travels without its line.  Segments of lines of SHORT characters would be too short to
tell lines apart: those, and lines that are longer by one, have what one deletion leaves of them as keys.

Lines that share a key form a bucket.  Buckets over ``block`` lines are not compared but split again by segments of
what is left of their lines, up to LEVELS times; what is still larger is compared in pairs of blocks.  In a bucket
letter counts rule most pairs out and a banded bit-parallel edit distance decides.  Components of the links are the
classes.  Any two near lines are in one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.llm.graph import connected_components
from quantmill.llm.shared import sent, written
from quantmill.llm.text import digest, has_word, whole

EDITS = 2
#: Characters that allow an edit; lines of so many meet by what one deletion leaves of them, shorter ones not at all.
SHORT = 8
BLOCK = 512
#: How often the lines of a key are split before blocks of them are compared.
LEVELS = 3
#: So many keys, ids or classes may be sent to all tasks (rows of 8 to 100 bytes; counted first).
FEW = 1 << 18


def allowed(length: int, edits: int = EDITS, short: int = SHORT) -> int:
    """Edits that make lines near, the shorter of which has ``length`` characters."""
    return min(edits, length // short)


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is ``edits`` or less: Myers's bit vectors on a band of 2 * edits + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n = len(a)
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : len(b) - tail]
    if not a:
        return len(b) <= edits
    # Column by column.  The band holds rows j - edits .. j + edits of column j as vertical differences: bit i of
    # ``plus`` (``minus``) says that its row i is one more (less) than the row above it.
    width = 2 * edits + 1
    full = (1 << width) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << (i + edits)
    plus, minus, score = full >> edits << edits, 0, edits  # score: the band's lowest row
    for j, c in enumerate(b):
        same = (at.get(c, 0) >> j) & full
        d0 = ((((same & plus) + plus) ^ plus) | same | minus) & full
        hp, hn = (minus | ~(d0 | plus)) & full, d0 & plus
        plus, minus = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        score += not d0 >> (width - 1) & 1
        if score > 3 * edits:
            return False
    # The differences are those of the next column's band, a row lower; go up from row len(b) + edits to row len(a).
    for i in range(width - 2, len(a) - len(b) + edits - 1, -1):
        score += (minus >> i & 1) - (plus >> i & 1)
    return score <= edits


def shifts(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(less, i, shift): where the i-th segment of a line that is ``less`` characters shorter can stand in a line.

    It can be shifted by what the edits before it and after it allow.
    """
    return [(less, i, s) for less in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, less - edits + i), min(i, less + edits - i) + 1)]


def with_cuts(rows: DataFrame, text: str, edits: int = EDITS) -> DataFrame:
    """Adds n, the length of a text, and c<less>_<k>, where the k-th segment of a text ``less`` characters shorter starts.

    The last segments are longer by one where the length does not divide.  As columns of their own these are computed
    once a text.
    """
    rows, n = rows.withColumn("n", F.char_length(text)), F.col("n")
    whole_part = lambda less: F.floor((n - less) / (edits + 1))
    more = lambda less, k: F.greatest(F.lit(0), (n - less) % (edits + 1) - (edits + 1 - k))
    return rows.select("*", *[(whole_part(less) * k + more(less, k)).cast("int").alias(f"c{less}_{k}") for less in range(edits + 1) for k in range(edits + 2)])


def places(edits: int = EDITS) -> list[tuple[Column, Column, Column]]:
    """(start, end, number that keys of this length and segment share) for each of ``shifts``, from the columns of with_cuts.

    In texts shorter than the segments are many, some places are not in the text; their keys meet nothing that matters.
    """
    return [(F.col(f"c{less}_{i}") + shift, F.col(f"c{less}_{i + 1}") + shift, (F.col("n") - less) * (edits + 1) + i) for less, i, shift in shifts(edits)]


def _deletions(text: Column) -> Column:
    """A text, and what is left of it after one deletion."""
    drop = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1 << 20)))
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.char_length(text)), drop)))


def segment_keys(text: Column, path: Column, edits: int = EDITS) -> Column:
    """Array of (key, place): a text's segments and probes, hashed with ``path``.  place numbers ``shifts``."""
    return F.array(*[F.struct(F.xxhash64(F.substring(text, a + 1, b - a), seed, path).alias("key"), F.lit(k).cast("byte").alias("place")) for k, (a, b, seed) in enumerate(places(edits))])


def line_keys(lines: DataFrame, edits: int = EDITS, short: int = SHORT) -> DataFrame:
    """(key, id, place) of each line of ``short`` characters or more; place is -1 for keys that deletions leave."""
    deleted = F.transform(_deletions(F.col("line")), lambda x: F.struct(F.xxhash64(x, F.lit(-1)).alias("key"), F.lit(-1).cast("byte").alias("place")))
    lines = with_cuts(lines.select(F.xxhash64("line").alias("id"), "line"), "line", edits).filter(F.col("n") >= short)
    lines = lines.withColumn("cut", F.when(F.col("n") > short, segment_keys(F.col("line"), F.lit(0).cast("long"), edits)))
    keys = F.when(F.col("n") > short + 1, F.col("cut")).when(F.col("n") > short, F.concat("cut", deleted)).otherwise(deleted)
    return lines.select("id", keys.alias("x")).select("id", F.explode_outer("x").alias("x")).select("x.key", "id", "x.place")  # outer: no test for empty arrays, which would make the keys twice


def _rest(text: Column, place: Column, edits: int) -> Column:
    """A text without the segment at a place, from the columns of with_cuts."""
    a, b, _ = (F.array(*column) for column in zip(*places(edits), strict=True))
    start, end = F.greatest(F.lit(0), F.get(a, place)), F.greatest(F.lit(0), F.get(b, place))
    return F.concat(F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.lit((1 << 31) - 1)))


def forest(lines: list[str], edits: int = EDITS, short: int = SHORT) -> list[tuple[str, str]]:
    """Links of a spanning forest of near lines.  Letters counted in 64 classes rule pairs out first."""
    near_lines = lambda a, b: within(a, b, allowed(min(len(a), len(b)), edits, short))
    if len(lines) == 2:
        return [(lines[0], lines[1])] if near_lines(*lines) else []
    counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64).astype(np.int32) for x in lines])
    left, links = np.arange(len(lines)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.abs(counts[left] - counts[at]).sum(axis=1) <= 2 * edits
            near[near] = [near_lines(lines[at], lines[x]) for x in left[near]]
            found, left = left[near], left[~near]
            links += [(lines[at], lines[x]) for x in found]
            front += found.tolist()
    return links


def _linker(edits: int, short: int):
    name = lambda x: hashlib.md5(x.encode()).hexdigest()  # noqa: E731 - as digest() gives

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name(a), name(b)) for lines in batch["lines"] for a, b in forest(list(lines), edits, short)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="object")

    return link


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, at, line): the lines with a word of each document; ``doc`` tells rows of one id apart by content."""
    text = whole(F.col("text"))
    docs = docs.select("doc_id", F.xxhash64(text).alias("doc"), F.split(text, "\n").alias("lines"))  # below the explode: once a text
    lines = docs.select("doc_id", "doc", F.posexplode_outer("lines").alias("at", "line")).filter(has_word(F.col("line")))  # outer: no test for empty arrays, which would split twice
    return lines.withColumn("line", F.lower(F.trim("line")))


def _shared(keys: DataFrame, edits: int) -> DataFrame:
    """Keys that different lines have, one of them as a segment of its own (or by deletions)."""
    own = [-1, *(k for k, (less, _, shift) in enumerate(shifts(edits)) if not less and not shift)]
    found = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("place").isin(own)).alias("any"))
    return written(found.filter("a <> b and any").select("key"))


def _buckets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of ``lines`` for each different set of ids that a key has, of ``block`` at most."""
    sets = members.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1).select("ids").distinct()
    return sets.select(F.xxhash64("ids").alias("set"), F.explode("ids").alias("id")).join(texts, "id").groupBy("set").agg(F.collect_set("line").alias("lines")).select("lines")


def _blocks(members: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Rows of ``lines`` in which every two lines of a key meet: pairs of blocks of its lines."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") * 2 / block).cast("int").alias("blocks"))
    met = members.select("key", "id").distinct().join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id").join(texts, "id")
    return met.groupBy("key", "p", "q").agg(F.collect_set("line").alias("lines")).select("lines")


def line_links(docs: DataFrame, block: int = BLOCK, edits: int = EDITS, short: int = SHORT, levels: int = LEVELS) -> DataFrame:
    """(a, b) digests of different near lines that connect all lines as all such pairs would."""
    lines = occurrences(docs).select("line")
    keys = line_keys(lines, edits, short)
    members = written(keys.join(sent(_shared(keys, edits), FEW), "key").select("key", "id", F.array("place").alias("path")).distinct())
    texts = lines.withColumn("id", F.xxhash64("line")).join(sent(written(members.select("id").distinct()), FEW), "id", "left_semi")
    texts, together = written(texts.distinct()), []
    for level in range(levels):
        large = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.get("path", F.lit(0))).alias("first")).filter(F.col("n") > block).select("key", "first"))
        if not large.count():
            break
        together.append(_buckets(members.join(large.select("key"), "key", "left_anti"), texts))
        stuck = large.filter("first < 0") if level < levels - 1 else large  # what deletions leave has no segments to split by
        together.append(_blocks(members.join(stuck.select("key"), "key", "left_semi"), texts, block))
        if level == levels - 1:
            members = members.limit(0)
            break
        deeper = members.join(large.filter("first >= 0").select("key"), "key", "left_semi").join(texts, "id").select("key", "id", "path", F.col("line").alias("rest"))
        for k in range(level + 1):
            deeper = with_cuts(deeper, "rest", edits).select("key", "id", "path", _rest(F.col("rest"), F.get("path", F.lit(k)), edits).alias("rest"))
        deeper = with_cuts(deeper, "rest", edits).select("id", "path", F.explode_outer(segment_keys(F.col("rest"), F.col("key"), edits)).alias("x"))
        deeper = written(deeper.select(F.col("x.key").alias("key"), "id", F.col("x.place").alias("place"), F.concat("path", F.array("x.place")).alias("path")))
        members = written(deeper.join(_shared(deeper, edits), "key").select("key", "id", "path").distinct())
    found = _buckets(members, texts)
    for more in together:
        found = found.union(more)
    return found.mapInPandas(_linker(edits, short), "a string, b string").distinct()


def line_classes(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """(doc_id, doc, at, first_doc_id, first_at, near): the lines that have an earlier line in their class.

    A class is named by its first line (by doc_id, then position); that line and lines alone in their class are left
    out.  ``near`` says that the line differs from the first.
    """
    roots = connected_components(line_links(docs, block, **options))
    seen = occurrences(docs).withColumn("line", digest(F.col("line")))
    seen = seen.join(sent(written(roots), FEW).withColumnRenamed("node", "line"), "line", "left").select("doc_id", "doc", "at", "line", F.coalesce("root", "line").alias("class"))
    first = seen.groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc", "at", "line")).alias("first")).filter("n > 1").drop("n")
    seen = seen.join(sent(written(first), FEW), "class").filter(~F.struct("doc_id", "doc", "at").eqNullSafe(F.struct("first.doc_id", "first.doc", "first.at")))
    return seen.select("doc_id", "doc", "at", F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at"), (F.col("line") != F.col("first.line")).alias("near"))


def dedup_lines(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_duplicates, n_near, members.

    ``members`` lists the document's lines that have an earlier line in their class, by position: (line, first_doc_id,
    first_line, near).  The class is named by its first line, so this is the membership of all classes; a line that is
    not listed is the first of its own.  n_duplicates counts the list, n_near those of it that differ from the first.
    Rows that repeat an id and a text count alike.  Null and empty texts have no lines.  Of equal lines in documents
    of one id, the one in the text with the lower hash comes first.  A line of any length counts as a whole.
    """
    found = line_classes(docs, block, **options).groupBy(F.col("doc_id").alias("i"), F.col("doc").alias("o"))
    found = found.agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("line"), "first_doc_id", F.col("first_at").alias("first_line"), "near"))).alias("members"))
    text = whole(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64(text).alias("doc"), F.size(F.filter(F.split(text, "\n"), has_word)).cast("long").alias("n_lines"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("doc") == F.col("o")), "left")
    none = F.array().cast(dict(found.dtypes)["members"])
    out = out.select("doc_id", "n_lines", F.coalesce("members", none).alias("members"))
    near = F.size(F.filter("members", lambda x: x["near"]))
    return out.select("doc_id", "n_lines", F.size("members").cast("long").alias("n_duplicates"), near.cast("long").alias("n_near"), "members")


def deduplicated(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """``docs`` with the lines that have an earlier line in their class cut out of ``text``; all columns and rows stay."""
    found = line_classes(docs, block, **options).groupBy(F.col("doc_id").alias("i"), F.col("doc").alias("o")).agg(F.collect_set("at").alias("gone")).select(F.struct("i", "o", "gone").alias("own"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("own.i")) & (F.xxhash64(whole(F.col("row.text"))) == F.col("own.o")), "left")
    left = F.array_join(F.filter(F.split(whole(F.col("row.text")), "\n"), lambda x, i: ~F.array_contains("own.gone", i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("own").isNull(), F.col("row.text")).otherwise(left))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines that a line before them is near to, and the first line of their class.

    ``members`` is a list of (line, first_doc_id, first_line, near); see dedup_lines for odd rows.
    """
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""License scans by patience alignment of texts with license templates.

Rare words of a template vote for places in a text where the template may start.  Where enough different ones agree,
the words of that window are aligned with the template: anchors are words unique to both, the longest increasing
subsequence of them is kept, and the gaps between them are aligned in the same way.  The share of a template's words
that are aligned is its coverage.  A text that holds as many of a template's words as its coverage asks for is aligned as a
whole, too: so long insertions do not hide a license.  Rows never leave their partition.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantmill.llm.license_texts import notices, texts

WORD = re.compile(r"[a-z0-9]+")
COVERAGE = 0.8
#: Share of a template's rare words that must agree on a place.
VOTES = 0.5
#: Aligned words may spread over so many times the template's words.
SPREAD = 3
#: Templates of fewer words are notices: all their words must stand together.
NOTICE = 20
# Words that are common in any text and say nothing about a place.
COMMON = set("a all and any are as at be by for free from in is it later may not of on option or other person that the this to under use with work you your".split())
TEMPLATES = notices() | texts()
#: Bytes of templates that tasks may hold.
MOST_BYTES = 16 << 20


def folder_templates(spark: SparkSession, path: str, most: int = MOST_BYTES) -> dict[str, str]:
    """Templates from a folder of UTF-8 texts, a whole license each, by file name without its ending.

    Files without a word are left out.  More than ``most`` bytes are an error, since every task holds all of them.
    """
    files = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value")
    size = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} bytes of templates; {most} are allowed")
    return {r["file_name"].rsplit(".", 1)[0]: r["value"] for r in files.collect() if WORD.search(r["value"].lower())}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose seconds increase: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1], at[pile : pile + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words of a and b, by patience: ends first, then unique words, then the gaps between."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        mine, other = Counter(a[i:n]), Counter(b[j:m])
        where = {w: k for k, w in enumerate(b[j:m], j) if other[w] == 1}
        anchors = increasing([(k, where[w]) for k, w in enumerate(a[i:n], i) if mine[w] == 1 and w in where])
        for (i0, j0), (i1, j1) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)], strict=True):
            if anchors:
                todo.append((i0 + 1, i1, j0 + 1, j1))
        found += anchors
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.words = {k: WORD.findall(t.lower()) for k, t in sorted(templates.items())}
        self.rare = {k: set(w) - COMMON for k, w in self.words.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.coverage, self.places = coverage, defaultdict(list)
        self.asked = {k: len(w) if len(w) < NOTICE else coverage * len(w) for k, w in self.words.items()}
        # A word that lacks is lost at least once, so a text with enough words has so many different rare ones.
        self.least = {k: len(self.rare[k]) - (len(w) - self.asked[k]) for k, w in self.words.items()}
        for k, words in self.words.items():
            for j, w in enumerate(words):
                if w in self.rare[k]:
                    self.places[w].append((k, j))

    def windows(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(template, first and last word) wherever enough of its rare words agree, and whole texts that hold enough of its words."""
        votes: dict = defaultdict(lambda: defaultdict(set))
        seen: dict = defaultdict(set)
        for i, w in enumerate(words):
            for k, j in self.places.get(w, ()):
                step = max(4, len(self.words[k]) // 4)
                seen[k].add(w)
                for cell in ((i - j) // step, (i - j) // step + 1):  # neighbours overlap, so no place is cut in two
                    votes[k][cell].add(w)
        found, held = [], None
        for k, cells in votes.items():
            size = len(self.words[k])
            step = max(4, size // 4)
            for cell, agreed in cells.items():
                if len(agreed) >= VOTES * len(self.rare[k]):
                    start = (cell - 1) * step
                    found.append((k, max(0, start), min(len(words), start + size + 2 * step)))
            if len(seen[k]) >= self.least[k]:
                held = held or Counter(words)
                if sum(min(n, held[w]) for w, n in self.counts[k].items()) >= self.asked[k]:
                    found.append((k, 0, len(words)))
        return sorted(found)

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) in code points; of places that overlap, the one with most words, then the best and shortest."""
        low = text.lower() if text.isascii() else "".join(x.lower() if x.isascii() else x for x in text)
        words, found = WORD.findall(low), []
        places = self.windows(words)
        at = [m.span() for m in WORD.finditer(low)] if places else []
        for k, first, last in places:
            size = len(self.words[k])
            pairs = align(words[first:last], self.words[k])
            spread = 1 if size < NOTICE else SPREAD
            if pairs and len(pairs) >= self.asked[k] and pairs[-1][0] - pairs[0][0] < spread * size:
                a, b = at[first + pairs[0][0]][0], at[first + pairs[-1][0]][1]
                found.append((-len(pairs), -len(pairs) / size, b - a, a, b, k))
        kept: list[tuple[int, int, str, float]] = []
        for _, c, _, a, b, k in sorted(found):
            if not any(s < b and a < e for s, e, _, _ in kept):
                kept.append((a, b, k, -c))
        return sorted(kept)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_licenses, licenses (template:start:end, by start), coverage (the best).

    Null and empty texts have none, and a coverage of 0.  Texts of any length are scanned as a whole; of places
    that overlap (ties) the one with most words counts.  Null and repeated ids stay as they are, other columns are not read.
    Templates are held by each task: a few kilobytes of public texts, or others, such as folder_templates() gives.
    """
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            all_found = [scanner.scan(x) if x else [] for x in batch["text"]]
            rows = [(len(x), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in x), max((c for *_, c in x), default=0.0)) for x in all_found]
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_licenses", "licenses", "coverage"])], axis=1)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(scan, f"doc_id {kind}, n_licenses long, licenses string, coverage double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with the licenses in its text; odd rows as in scan_licenses()."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

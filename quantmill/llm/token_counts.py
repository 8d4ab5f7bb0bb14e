"""Token counts through a digest cache: distinct texts that the cache lacks are encoded once and appended to it.

The cache is a Parquet table (version, digest, n_tokens): version is a digest of the tokenizer's file, digest that of
the text.  Texts are combined by digest before the shuffle, so a text that a third of all rows share travels about
once per task; the counts are then joined to the rows by digest, a join that Spark can split.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantmill.llm.shared import shared_folder, written
from quantmill.llm.text import packed, unpacked, whole

CONTEXT = 2048
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Words that a task remembers the counts of; beyond that it starts anew.
REMEMBERED = 1 << 20
#: Pre-tokenizers that drop white space and split at it, and normalisers that change no text across it.
SPLITTERS, ALONE = {"BertPreTokenizer", "Whitespace", "WhitespaceSplit"}, {"BertNormalizer", "Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents"}
#: Fixed value: the pattern of a public tokenizer that keeps its matches alone; none of them holds white space.
NO_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: So many digests of 32 bytes may be sent to all tasks.
FEW = 1 << 17


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def version_of(path: str) -> str:
    """A digest of the tokenizer's file and of the way it is called."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain:" + f.read()).hexdigest()


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file says that pieces end at white space, that it drops it, and that words are normalised alone."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    parts = lambda x, key: [] if x is None else x[key] if x.get("type") == "Sequence" else [x]
    first = next(iter(parts(made.get("pre_tokenizer"), "pretokenizers")), {})
    splits = first.get("type") in SPLITTERS or (first.get("type"), first.get("behavior"), first.get("invert"), first.get("pattern")) == ("Split", "Removed", True, {"Regex": NO_SPACES})
    alone = all(x["type"] in ALONE or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in parts(made.get("normalizer"), "normalizers"))
    return splits and alone and not any(set(x["content"]) & set(" \t\r\n") or x.get("lstrip") or x.get("rstrip") for x in made.get("added_tokens", []))


class WordCounts(dict):
    """Token counts of words, filled by the tokenizer as words are met.

    Where a tokenizer's pieces end at white space and its normaliser does not look across it, a text's count is the sum
    over the parts between spaces, tabs and line ends.  Of any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = splits_at_spaces(path)

    def of(self, texts: list[str], together: int = 64) -> list[int]:
        """Counts of the texts, ``together`` of them at a time, so that the words of few are held at once."""
        return [n for at in range(0, len(texts), together) for n in self._of(texts[at : at + together])]

    def _of(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        new = list({w for x in parts for w in x if w not in self})
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list({w for x in parts for w in x})
        self.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [sum(map(self.__getitem__, x)) for x in parts]


def _encoder(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = WordCounts(path)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counts.of(batch["text"].tolist())})

    return encode


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Appends the counts of the distinct texts of ``docs`` that the cache lacks.

    ``cache`` is a path that all executors share; it is made if it does not exist.  A task that is lost is run again,
    and only whole appends are seen.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    text = whole(F.col("text"))
    rows = docs.select(text_digest(text).alias("digest"), text.alias("text"))
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version).select("digest")
    absent = written(rows.select("digest").distinct().join(known, "digest", "left_anti"))  # digests first: texts that the cache knows do not travel
    if absent.count() <= FEW:
        rows = rows.join(F.broadcast(absent), "digest", "left_semi")
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text")).join(absent, "digest", "left_semi")
    missing = distinct.mapInPandas(_encoder(tokenizer), "digest binary, n_tokens long")
    missing.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, context: int = CONTEXT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; null texts count as empty, repeated rows stay.

    Texts of any length are counted as a whole; equal texts (ties) have one entry in the cache.  Columns of ``docs``
    that have these three names are replaced, all others stay.
    """
    fill_cache(docs, tokenizer, cache)
    known = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version_of(tokenizer))
    known = known.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))  # jobs that ran at once may have stored a text twice
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    text = whole(F.col("row.text"))
    rows = packed(docs).withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("digest", text_digest(text)).join(known, "digest", "left")
    return rows.select(*unpacked(names), "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """A new cache for each call, so that every call does all the work."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")

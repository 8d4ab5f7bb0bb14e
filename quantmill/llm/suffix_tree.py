"""Language-model scores from a probabilistic suffix tree, next to exact add-one word scores.

Symbols are the bytes of the normalised text (A-Z lower-cased, one space after each word) and an end mark.  The 62
most frequent byte values of the training texts have symbols of their own; the rest share one and split it evenly.
Contexts of up to DEPTH symbols are kept where their next-symbol distribution diverges from that of their suffix.  A
text is scored symbol by symbol at the longest kept suffix.  The tree has at most 64**(DEPTH + 1) entries at any size
of the corpus, which bounds what is gathered and sent; all training texts are counted.  The tree spells a token (a
word and its space, or the end mark); this is smoothed with the share of the token among the training tokens:
p = LEXICON * share + (1 - LEXICON) * spelling.  Both sum to 1 over all tokens, and so does p.

Longer contexts have no bound: they grow with the corpus and never leave Spark's tables.  The words before every token,
at every place of every text, are contexts of 3, 6, 12, ... words (``word_contexts``); each that is kept gives a token
(n + kinds * p) / (N + kinds), where p is what the shorter contexts give it, so the sum stays 1.

On request contexts are whole phrases instead (``phrase_bits``): a text is cut where the hash of two words in a row says
so, and the whole phrase before is a context, of any length, whose next symbol is a phrase.  That is cheaper, but contexts
begin and end at cuts only.  It is kept where it was seen SUPPORT times or more and the phrases after it diverge from
their spelling at the suffix of DEPTH bytes.  A kept context gives a phrase seen after it n / (N + kinds), and leaves
kinds / (N + kinds) to the tokens of any other.

Words have no such bound.  Those with a count of at least a power of two, chosen so that no more than FREQUENT words
pass, are sent to the tasks; the others are joined by word with their spelling, and their shares enter the score then.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantmill.llm import word_contexts
from quantmill.llm.shared import written, written_and_freed
from quantmill.llm.word_contexts import BASE, BYTE_CODES, MARK, SUPPORT, Chunk, Spans, bare, blended, bytes_of, stops_of, tokens_of, words_of

DEPTH = 3
BITS = 6
SYMBOLS = 1 << BITS
END, OTHER = 0, 1
#: A context is kept if its divergence from its suffix, summed over its occurrences, is this many nats or more.
DIVERGENCE = 8.0
FREQUENT = 1 << 18
#: Held out: crc32 of the id as text leaves HELD_OUT when divided by FOLDS.
FOLDS, HELD_OUT = 7, 2
#: Weight of a token's own share against its spelling.
LEXICON = 0.8
CHUNK = 1 << 19
#: Distinct words that a task counts before it passes counts on, and symbols, so that 32 bits hold each count.
HELD_WORDS = 1 << 17
HELD_SYMBOLS = 1 << 31
WHITE = (9, 10, 11, 12, 13, 32)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of some batches, about CHUNK characters at a time, so that a task holds the words of few texts at once."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).cumsum().to_numpy() // CHUNK
        cuts = [0, *(np.nonzero(np.diff(size))[0] + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.iloc[a:b].reset_index(drop=True)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _chunks(texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """Some texts at a time: number of the first, starts, ends and bytes; the end mark three times before each text and once after."""
    some, first, size = [], 0, 0
    for i, words in enumerate(texts):
        some.append(b" ".join([*words, b""]))
        size += len(some[-1])
        if size >= CHUNK or i == len(texts) - 1:
            n = np.fromiter(map(len, some), np.int64, len(some))
            starts = DEPTH + np.concatenate(([0], np.cumsum(n + DEPTH)[:-1]))
            yield first, starts, starts + n, bytes([MARK] * DEPTH) + bytes([MARK] * DEPTH).join(some) + bytes([MARK])
            some, first, size = [], i + 1, 0


def _codes(data: bytes, symbol: np.ndarray) -> np.ndarray:
    """For each position from DEPTH on: the symbols of its context and its own, BITS each."""
    s = symbol[np.frombuffer(data, np.uint8)].astype(np.int32)
    n = len(s) - DEPTH
    out = np.zeros(n, np.int32)
    for k in range(DEPTH + 1):
        out = (out << BITS) | s[k : k + n]
    return out


def symbol_table(counts: dict[int, int]) -> np.ndarray:
    """Symbol of each byte value: the most frequent ones (ties: the lower) have their own."""
    own = sorted(counts, key=lambda b: (-counts[b], b))[: SYMBOLS - 2]
    table = np.full(256, OTHER, np.uint8)
    table[sorted(own)] = np.arange(2, 2 + len(own))
    table[MARK] = END
    return table


def _count_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for text in batch["text"]:
            total += bytes_of(b" ".join(words_of(text)))
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"byte": at, "n": total[at]})


def _phrases(raw: np.ndarray, start: np.ndarray, end: np.ndarray, opens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token of each phrase, hash of the phrase) for tokens from ``start`` to ``end``; ``opens``: first of a text."""
    spans = Spans(BYTE_CODES[raw])
    pair = np.where(opens, start, np.concatenate((start[:1], start[:-1])))
    cut = (spans.hashes(pair, end) >> np.uint64(64 - bits) == 0) if bits else np.ones(len(end), bool)
    last = np.nonzero(cut | np.concatenate((opens[1:], [True])))[0]
    first = np.concatenate(([0], last[:-1] + 1))
    return first, spans.hashes(start[first], end[last]).view(np.int64)


def _symbols(seen: np.ndarray) -> pd.DataFrame:
    """Rows (null, code, n) of what was seen, which is forgotten."""
    code = np.nonzero(seen)[0]
    n = seen[code].astype(np.int64)
    seen[code] = 0
    return pd.DataFrame({"word": None, "code": code, "n": n})


def _counter(symbol: np.ndarray):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (word, null, n) and (null, code, n): what this task has read of the training texts."""
        _DENSE.clear()  # of a former tree: nobody scores while words are counted
        word_contexts.give_back()
        words: Counter = Counter()
        seen, held = np.zeros(SYMBOLS ** (DEPTH + 1), np.uint32), 0
        for batch in _parts(batches):
            texts = [words_of(x) for x in batch["text"]]
            for x in texts:
                words.update(x)
            words[b""] += len(texts)
            for _, _, ends, data in _chunks(texts):
                c = _codes(data, symbol)
                skip = np.add.outer(ends[:-1] - DEPTH, np.arange(1, DEPTH)).ravel()  # separators after the end mark
                if held and held + len(c) > HELD_SYMBOLS:
                    yield _symbols(seen)
                    held = 0
                np.add.at(seen, np.delete(c, skip), np.uint32(1))  # of its own kind: another one is much slower
                held += len(c)
            if len(words) > HELD_WORDS:
                yield pd.DataFrame({"word": list(words), "code": None, "n": list(words.values())})
                words.clear()
        yield pd.DataFrame({"word": list(words), "code": None, "n": list(words.values())})
        yield _symbols(seen)

    return count


def _coded(data: bytes, symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed texts, CHUNK symbols at a time: number of the first, codes of all, and which are separators after an end mark.

    The end mark stands DEPTH times before each text here, so text ``i`` begins ``i * (DEPTH - 1)`` symbols later than in the data.
    """
    ends = np.nonzero(np.frombuffer(data, np.uint8) == MARK)[0]
    skip = np.add.outer(ends + np.arange(len(ends)) * (DEPTH - 1), np.arange(1, DEPTH)).ravel()
    data = bytes([MARK] * DEPTH) + data.replace(bytes([MARK]), bytes([MARK] * DEPTH))
    for a in range(0, len(data) - DEPTH, CHUNK):
        c = _codes(data[a : a + CHUNK + DEPTH], symbol)
        yield a, c, skip[slice(*np.searchsorted(skip, (a, a + len(c))))] - a


def _chunk_counter(symbol: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As _counter(), of the learnt texts of chunks."""
        _DENSE.clear()
        word_contexts.give_back()
        seen, held = np.zeros(SYMBOLS ** (DEPTH + 1), np.uint32), 0
        for c in _rows(batches):
            texts = pa.decompress(c["packed"], c["size"], "zstd", asbytes=True).split(bytes([MARK]))
            data = b"".join([t + bytes([MARK]) for t, out in zip(texts, c["held"]) if not out])
            words = tokens_of(data, stops_of(data)).value_counts()
            yield _count_rows(word=bare(words.field("values")), n=words.field("counts"))
            for _, codes, skip in _coded(data, symbol):
                if held and held + len(codes) > HELD_SYMBOLS:
                    yield _symbol_rows(seen)
                    held = 0
                np.add.at(seen, codes, np.uint32(1))  # of its own kind: another one is much slower
                np.subtract.at(seen, codes[skip], np.uint32(1))
                held += len(codes)
        yield _symbol_rows(seen)

    return count


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _count_rows(n, word=None, code=None) -> pa.RecordBatch:
    kinds = {"word": pa.binary(), "code": pa.int32(), "n": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.nulls(len(n), t) if x is None else pa.array(x, t) for (k, t), x in zip(kinds.items(), (word, code, n))})


def _symbol_rows(seen: np.ndarray) -> pa.RecordBatch:
    rows = _symbols(seen)
    return _count_rows(code=rows["code"].to_numpy(np.int32), n=rows["n"].to_numpy())


def build_tree(code: np.ndarray, n: np.ndarray, divergence: float = DIVERGENCE) -> list[tuple[np.ndarray, ...]]:
    """For each length of context from 0: (codes of context and next symbol, probability, contexts kept, their backoff).

    A context is kept if it or a longer one that ends in it passes the divergence test.  Probabilities are smoothed
    with the suffix's: (count + kinds * suffix's) / (total + kinds), where kinds counts the symbols seen next.
    """
    levels = []
    for k in range(DEPTH + 1):
        c, at = np.unique(code & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
        levels.append((c, np.bincount(at, n, len(c))))
    kept: list = [None] * (DEPTH + 1)
    for k in range(DEPTH, 0, -1):
        c, m = levels[k]
        context, at = np.unique(c >> BITS, return_inverse=True)
        up, um = levels[k - 1]
        mask = (1 << BITS * k) - 1
        shorter, total_up = np.unique(up >> BITS, return_inverse=True)
        sums = np.bincount(total_up, um)
        p = m / np.bincount(at, m)[at]
        q = um[np.searchsorted(up, c & mask)] / sums[np.searchsorted(shorter, (c & mask) >> BITS)]
        passed = context[np.bincount(at, m * np.log(p / q)) >= divergence]
        longer = kept[k + 1] & mask if k < DEPTH and len(kept[k + 1]) else np.zeros(0, np.int64)
        kept[k] = np.union1d(passed, longer)
    kept[0] = np.zeros(1, np.int64)
    tree: list = []
    for k in range(DEPTH + 1):
        c, m = levels[k]
        inside = np.isin(c >> BITS, kept[k])
        c, m = c[inside], m[inside]
        context, at, kinds = np.unique(c >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(at, m)
        if k:
            up, q, _, _ = tree[k - 1]
            lower = q[np.searchsorted(up, c & ((1 << BITS * k) - 1))]
        else:
            lower = np.full(len(c), 1 / SYMBOLS)
        tree.append((c, (m + kinds[at] * lower) / (total + kinds)[at], context, kinds / (total + kinds)))
    return tree


def dense_scores(tree: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 probability of every symbol after every context of DEPTH symbols, at the longest kept suffix."""
    every = np.arange(SYMBOLS, dtype=np.float64)
    table = np.full((1, SYMBOLS), tree[0][3][0] / SYMBOLS if len(tree[0][3]) else 1 / SYMBOLS) + 0 * every
    for k, (code, p, context, backoff) in enumerate(tree):
        if k:
            table = np.tile(table, (SYMBOLS, 1))
            table[context] *= backoff[:, None]
        table.ravel()[code] = p
        table = table.astype(np.float32) if k >= 2 else table
    return np.log10(table, out=table).ravel()


def train(docs: DataFrame, divergence: float = DIVERGENCE, packed: DataFrame | None = None) -> tuple:
    """(symbol table, share of the common symbol, tree, counts (word, n) with the end mark as the empty word); ``packed``: the chunks, if made."""
    text = docs.select("text")
    seen = text.mapInPandas(_count_bytes, "byte int, n long") if packed is None else packed.select(F.posexplode("bytes").alias("byte", "n"))
    seen = seen.filter("n > 0").groupBy("byte").agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    symbol = symbol_table({r["byte"]: r["n"] for r in seen})
    kind = "word binary, code int, n long"
    counts = text.mapInPandas(_counter(symbol), kind) if packed is None else packed.select("held", "size", "packed").mapInArrow(_chunk_counter(symbol), kind)
    counts = written_and_freed(counts.groupBy("word", "code").agg(F.sum("n").alias("n")))
    codes = counts.filter("code is not null").select("code", "n").toPandas().sort_values("code")  # the tree's bound
    tree = build_tree(codes["code"].to_numpy(np.int64), codes["n"].to_numpy(np.int64), divergence)
    return symbol, 1 / max(1, int((symbol == OTHER).sum()) - sum(symbol[b] == OTHER for b in WHITE)), tree, counts.filter("code is null").select("word", "n")


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[int, dict[bytes, int]]:
    """(least count, counts of the words that have it): as many words as powers of two allow, no more than ``most``."""
    by = {r["b"]: r["k"] for r in counts.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("k")).collect()}
    least = 64
    while least > 1 and sum(k for b, k in by.items() if b >= least - 1) <= most:
        least -= 1
    rows = counts.filter(F.col("n") >= 1 << (least - 1)).toPandas() if least < 64 else pd.DataFrame({"word": [], "n": []})
    return 1 << (least - 1), dict(zip(map(bytes, rows["word"]), rows["n"].tolist(), strict=True))


#: Of the tree that this process has last scored with (its id, itself, its scores): tasks of a process share it.
_DENSE: list = []


def _dense(tree: list, share: float) -> np.ndarray:
    """dense_scores(), with the share of a byte in the common symbol."""
    if _DENSE[:1] != [id(tree)]:
        _DENSE[:] = [id(tree), tree, dense_scores(tree)]
        _DENSE[2].reshape(-1, SYMBOLS)[:, OTHER] += np.log10(share)
    return _DENSE[2]


def _scorer(model, bits: int):
    """Scores of texts, with their phrases."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_contexts.give_back()
        symbol, share, tree, counts, tokens = model.value
        table = _dense(tree, share)
        for batch in _parts(batches):
            texts = [words_of(x) for x in batch["text"]]
            known, base, rest, shares, phrases = [], [], [], [], []
            rare: list[dict] = [{} for _ in texts]
            for words in texts:
                got = [counts.get(w, 0) for w in words] + [counts.get(b"", 0)]
                c = np.array(got, np.float64)
                known.append(int(np.count_nonzero(c)))
                base.append(float(np.log10(c + 1).sum()))
                shares.append(c)
                rest.append([w for w, x in zip([*words, b""], got, strict=True) if not x])
            total = np.zeros(len(texts))
            for first, starts, ends, data in _chunks(texts):
                codes = _codes(data, symbol)
                p = np.concatenate(([0.0], np.cumsum(table[codes], dtype=np.float64)))
                raw = np.frombuffer(data, np.uint8)[DEPTH:]
                stop = raw == 32
                stop[ends - DEPTH] = True  # the end mark
                stops = np.nonzero(stop)[0] + 1
                upto = p[stops]
                text_of = np.searchsorted(ends - DEPTH + 1, stops)  # which text a token is of
                before = np.concatenate(([0.0], upto[:-1]))
                opens = np.concatenate(([True], text_of[1:] != text_of[:-1]))
                before[opens] = p[starts - DEPTH]
                c, spelling = np.concatenate(shares[first : first + len(starts)]), upto - before
                own = c > 0
                token = np.log10(1 - LEXICON) + spelling  # long words fall below the least number there is
                token[own] = np.log10(LEXICON * c[own] / tokens + (1 - LEXICON) * 10.0 ** spelling[own])
                ends_at = np.cumsum([len(x) for x in rest[first : first + len(starts)]])
                begins = np.concatenate(([0], stops[:-1]))
                begins[opens] = starts - DEPTH
                heads, names = _phrases(raw, begins, stops, opens, bits)
                of_text = np.searchsorted(text_of[heads], np.arange(len(starts) + 1))  # the first phrase of each text
                place = np.repeat(np.arange(len(heads)) - of_text[text_of[heads]], np.diff(np.append(heads, len(stops))))
                for i, part, at in zip(range(first, first + len(starts)), np.split(np.round(spelling[~own], 9), ends_at[:-1]), np.split(place[~own], ends_at[:-1]), strict=True):
                    rare[i] = Counter(zip(rest[i], part.tolist(), at.tolist(), strict=True))
                phrases += zip(*[np.split(x, of_text[1:-1]) for x in (names, np.add.reduceat(token, heads), np.add.reduceat(spelling, heads))], strict=True)
                total[first : first + len(starts)] = np.bincount(text_of, token, len(starts))
            out = {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": [len(x) + 1 for x in texts], "known": known, "base": base, "score": total}
            out |= {c: [[key[k] for key in x] for x in rare] for k, c in enumerate(("rare", "spelling", "at"))} | {"times": [list(x.values()) for x in rare]}
            yield pd.DataFrame(out | {c: [x[k] for x in phrases] for k, c in enumerate(("phrase", "q", "spelled"))})

    return score


def _chunk_scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of chunks with the answers to their contexts of words; each different word of a chunk is looked up once."""
        word_contexts.give_back()
        symbol, share, tree, counts, tokens = model.value
        table = _dense(tree, share)
        for row in _rows(batches):
            yield _chunk_scores(row, symbol, table, counts, tokens)

    return score


def _chunk_scores(row: dict, symbol: np.ndarray, table: np.ndarray, counts: dict[bytes, int], tokens: int) -> pa.RecordBatch:
    """The scores of one chunk; no working array outlives it."""
    chunk = Chunk(row["size"], row["packed"], row["held"])
    heads, n_tokens = chunk.heads[:-1], np.diff(chunk.heads)
    a, b = blended(chunk, row["first"], row["longer"])
    begins = chunk.start + np.repeat(np.arange(len(heads)) * (DEPTH - 1), n_tokens)
    spelling = np.zeros(len(begins))
    for at, codes, skip in _coded(chunk.data, symbol):
        letters = table[codes].astype(np.float64)
        letters[skip] = 0
        i, j = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + len(codes))
        spelling[i:j] += np.add.reduceat(letters, np.maximum(begins[i:j] - at, 0))  # the first may have begun before
    words, word = chunk.words()
    found = np.array([counts.get(w, 0) for w in words.to_numpy(zero_copy_only=False)], np.float64)
    c = found[word]
    p = LEXICON * c / tokens + (1 - LEXICON) * 10.0**spelling
    own = c > 0
    token = np.log10(1 - LEXICON) + spelling  # long words fall below the least number there is
    token[own] = np.log10(p[own])
    at = np.nonzero(b < 1)[0]
    token[at] += np.log10(b[at])
    at = np.nonzero(a > 0)[0]
    token[at] = np.log10(a[at] + b[at] * p[at])
    rest = np.nonzero(~own)[0]
    ends = pa.array(np.searchsorted(rest, chunk.heads), pa.int32())
    out = {"doc_id": pa.array(row["ids"], pa.string()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": n_tokens, "known": np.add.reduceat(own.astype(np.int64), heads)}
    out |= {"base": np.add.reduceat(np.log10(found + 1)[word], heads), "score": np.add.reduceat(token, heads)}
    lists = {"rare": words.take(pa.array(word[rest])), "spelling": pa.array(spelling[rest]), "ratio": pa.array(a[rest] / b[rest])}
    return pa.RecordBatch.from_pydict(out | {k: pa.ListArray.from_arrays(ends, x) for k, x in lists.items()})


def _places(rows: DataFrame) -> DataFrame:
    """(row, held_out, at, ctx, phrase, q, spelled): the phrases that have one before them in their text."""
    later = F.size("phrase") - 1
    zipped = F.arrays_zip(F.slice("phrase", F.lit(1), later).alias("ctx"), F.slice("phrase", F.lit(2), later).alias("phrase"), F.slice("q", F.lit(2), later).alias("q"), F.slice("spelled", F.lit(2), later).alias("spelled"))
    places = rows.select("row", "held_out", F.posexplode(zipped).alias("at", "x"))
    places = places.select("row", "held_out", (F.col("at") + 1).alias("at"), *[F.col(f"x.{c}").alias(c) for c in ("ctx", "phrase", "q", "spelled")])
    return places.filter("ctx is not null and phrase is not null")  # none are: so the plans that read them are equal


def long_contexts(places: DataFrame, divergence: float = DIVERGENCE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(pairs, contexts) of the training phrases: (ctx, phrase, n, spelled), and (ctx, total, kinds) of the contexts kept.

    The divergence is that of the next phrases from their spelling, summed over the occurrences of the context, in nats.
    """
    pairs = places.filter("not held_out").groupBy("ctx", "phrase").agg(F.count("*").alias("n"), F.min("spelled").alias("spelled"))
    n = F.col("n").cast("double")
    found = pairs.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(n * (F.ln(n) - F.col("spelled") * float(np.log(10)))).alias("gain"))
    kept = found.filter((F.col("total") >= support) & (F.col("gain") - F.col("total") * F.ln("total") >= divergence))
    return pairs, kept.select("ctx", "total", "kinds")


def _long_context_scores(rows: DataFrame, divergence: float) -> DataFrame:
    """(row, at, credit, escape): credit replaces the tokens' score of a phrase known after its context, escape adds to that of others."""
    places = _places(rows)
    pairs, contexts = long_contexts(places, divergence)
    # Sorted and merged at any size: no table that grows with the corpus is sent, and Spark can split a context of very many places.
    asked = places.select("row", "at", "ctx", "phrase", "q").join(contexts.hint("merge"), "ctx").join(pairs.hint("merge"), ["ctx", "phrase"], "left")
    known, mass = F.col("spelled").isNotNull(), F.col("total") + F.col("kinds")
    return asked.select("row", "at", F.when(known, F.log10(F.col("n") / mass) - F.col("q")).alias("credit"), F.when(~known, F.log10(F.col("kinds") / mass)).alias("escape"))


def score(docs: DataFrame, frequent: int = FREQUENT, divergence: float = DIVERGENCE, phrase_bits: int | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the columns of the contract.

    Null texts count as empty: they are the end mark alone.  Null ids have the empty text as their text.  With no
    training text all counts are 0 and the tree knows nothing: each symbol has the same probability.  Texts of any
    length are scored as a whole; repeated rows are trained on and scored each.  Words of equal count (ties) are all
    sent or all joined, and their score is the same either way.  ``phrase_bits``: contexts are phrases, which end after
    one word in so many, as a power of two.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    packed = written(word_contexts.chunks(docs)) if phrase_bits is None else None
    symbol, share, tree, counts = train(docs.filter(~F.col("held_out")), divergence, packed)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least, words = frequent_words(counts, frequent)
    model = docs.sparkSession.sparkContext.broadcast((symbol, share, tree, words, max(1, total["n"])))
    numbers = "held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, spelling array<double>"
    if phrase_bits is None:
        texts = word_contexts.answered(packed.drop("bytes"), written_and_freed)
        rows = written_and_freed(texts.mapInArrow(_chunk_scorer(model), f"doc_id string, {numbers}, ratio array<double>"))
        rows = rows.withColumn("doc_id", F.col("doc_id").cast(kind))
    else:
        schema = f"doc_id {kind}, {numbers}, at array<int>, times array<long>, phrase array<long>, q array<double>, spelled array<double>"
        rows = written(docs.mapInPandas(_scorer(model, phrase_bits), schema))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # written first: ids stay
    place = "ratio" if phrase_bits is None else "at"
    columns = {"rare": "word", "spelling": "spelling", place: place} | ({"times": "k"} if phrase_bits is not None else {})
    tail = rows.select("row", F.explode(F.arrays_zip(*columns)).alias("x")).select("row", *[F.col(f"x.{c}").alias(d) for c, d in columns.items()])
    tail = tail if phrase_bits is not None else tail.withColumn("k", F.lit(1))
    tail = tail.join(counts.filter(F.col("n") < least), "word")
    share_of = LEXICON * F.col("n") / max(1, total["n"]) + (1 - LEXICON) * F.pow(F.lit(10.0), "spelling")
    alone = F.log10(F.lit(1 - LEXICON)) + F.col("spelling")  # a word of no share, as which the task has scored it
    gain = F.log10(share_of) - alone
    if phrase_bits is None:
        gain = F.when(F.col("ratio") > 0, F.log10(F.col("ratio") + share_of) - F.log10(F.col("ratio") + F.pow(F.lit(10.0), alone))).otherwise(gain)
    logs = F.col("k") * F.log10(F.col("n") + 1)
    if phrase_bits is None:
        both = tail.select("row", "k", logs.alias("logs"), (F.col("k") * gain).alias("gain")).groupBy("row").agg(F.sum("k").alias("more"), F.sum("logs").alias("logs"), F.sum("gain").alias("gain"))
    else:
        tail = tail.select("row", "at", "k", logs.alias("logs"), (F.col("k") * gain).alias("gain"))
        both = tail.unionByName(_long_context_scores(rows, divergence), allowMissingColumns=True).repartition("row")  # serves both groupings
        both = both.groupBy("row", "at").agg(F.sum("k").alias("more"), F.sum("logs").alias("logs"), F.coalesce(F.max("credit"), F.coalesce(F.sum("gain"), F.lit(0.0)) + F.coalesce(F.max("escape"), F.lit(0.0))).alias("gain"))
        both = both.groupBy("row").agg(F.sum("more").alias("more"), F.sum("logs").alias("logs"), F.sum("gain").alias("gain"))
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(both, "row", "left")
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Every document with its base score and its score by the suffix tree; odd rows as in score()."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

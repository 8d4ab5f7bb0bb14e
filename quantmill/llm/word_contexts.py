"""Contexts of whole words before every token of a corpus, counted in Spark over packed arrays.

A token is a word or the end of a text.  Every token with FIRST words or more before it in its text is looked at: its
context are these words, as a learner and as a question.  A context is kept where some token follows it SUPPORT times or
more.  Kept contexts that more than one token follows are open: of these, contexts of 2, 4, 8, ... times FIRST words are
looked at too, back to the start of the text.  What one token alone follows can't be told apart by longer contexts.

A position costs a few bytes: a task sorts the hashes of (context, next token) of some megabytes of text, so that
only their differences are shuffled, in ranges of the hash.  What a range counts goes back in the same order.  The number
of ranges follows the corpus; nothing is gathered or sent.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in the shortest context.
FIRST = 3
#: What one place alone says is no regularity.
SUPPORT = 2
#: Bytes of text in a chunk, bytes hashed at a time, and tokens a range of hashes.
CHUNK_BYTES = 1 << 22
PIECE = 1 << 18
RANGE = 1 << 20
#: A context is known by the upper 56 bits of its hash, a token after it by 24: with 8 billion tokens (30 GB) some hundred contexts are taken for another.
CONTEXT = np.uint64(0xFFFFFFFFFFFFFF00)
NEXT_BITS = 24
#: A-Z in lower case.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end mark among the bytes: a line end, which no word holds.
MARK = 10
#: An odd base, so that it has an inverse modulo 2**64, and a random number for each byte value.
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)


def give_back() -> None:
    """The memory of freed arrays goes back to the system, where the C library can: a worker lives on, and would hold it in later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of another C library
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words in lower case; bytes are so already."""
    return text.split() if isinstance(text, bytes) else (text if isinstance(text, str) else "").encode().translate(NORMAL).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The powers of each base, as far as they were asked for.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, bits: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < 1 << bits:
        out = np.full(1 << bits, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.cumprod(out, out=out)
    return _POWERS[base][: 1 << bits]


class Spans:
    """Hashes of any spans of some codes (of bytes, or of tokens), the same for equal codes at any place."""

    def __init__(self, codes: np.ndarray):
        bits = len(codes).bit_length()
        self.back = _powers(pow(BASE, -1, 1 << 64), bits)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _powers(BASE, bits)[: len(codes)], dtype=np.uint64)))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def bytes_of(data: bytes) -> np.ndarray:
    """How often each byte value occurs in words."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n[[32, MARK]] = 0
    return n


# chunks --------------------------------------------------------------------------------------------------------------
def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of PACKED, with the bytes of learnt words: the normalised texts of about CHUNK_BYTES, each word and a space, MARK after a text."""
    give_back()
    seq, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

    def row():
        data = b"".join(texts)
        tokens = data.count(b" ") + len(texts)
        return pd.DataFrame({"chunk": [seq], "ids": [ids], "held": [held], "tokens": [tokens], "size": [len(data)], "bytes": [bytes_of(b"".join(t for t, out in zip(texts, held) if not out))], "packed": [pa.compress(data, "zstd", asbytes=True)]})

    for batch in batches:
        for i, out, text in zip(batch["id"], batch["held_out"], batch["text"]):
            ids.append(i if isinstance(i, str) else None)
            held.append(bool(out))
            texts.append(b" ".join([*words_of(text), bytes([MARK])]))
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield row()
                seq, ids, held, texts, size = seq + 1, [], [], [], 0
    if ids:
        yield row()


PACKED = "chunk long, ids array<string>, held array<boolean>, tokens long, size long, bytes array<long>, packed binary"


def chunks(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, held_out), packed.  To be written before use: its numbers are those of tasks."""
    return docs.select(F.col("doc_id").cast("string").alias("id"), "held_out", "text").mapInPandas(pack, PACKED)


def stops_of(data: bytes) -> np.ndarray:
    """Ends of the tokens of packed texts, each with the space or MARK that ends it; the first is where the texts begin."""
    raw = np.frombuffer(data, np.uint8)
    return np.concatenate(([-1], np.nonzero((raw == 32) | (raw == MARK))[0])) + 1


def tokens_of(data: bytes, stops: np.ndarray) -> pa.LargeBinaryArray:
    """The tokens, as they lie in the data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data)])


def bare(tokens: pa.Array) -> pa.Array:
    """Tokens without their last byte: words, and nothing for the end mark."""
    return pc.binary_slice(tokens, 0, -1).cast(pa.binary())


class Chunk:
    """The tokens of a chunk: code, number in its text, whether it is learnt."""

    def __init__(self, size: int, packed: bytes, held):
        self.data = pa.decompress(packed, size, "zstd", asbytes=True)
        raw, stops = np.frombuffer(self.data, np.uint8), stops_of(self.data)
        self.start, stop = stops[:-1], stops[1:]
        last = np.nonzero(raw[stop - 1] == MARK)[0]
        self.heads = np.concatenate(([0], last + 1))  # first token of each text, and one more
        n = np.diff(self.heads)
        self.place = np.arange(len(stop)) - np.repeat(self.heads[:-1], n)
        self.learnt = np.repeat(~np.asarray(list(held), bool), n)
        self.codes = np.zeros(len(stop), np.uint64)
        a = 0
        while a < len(stop):  # whole tokens, PIECE bytes at a time
            b = max(a + 1, int(np.searchsorted(stop, self.start[a] + PIECE)))
            spans = Spans(BYTE_CODES[raw[self.start[a] : stop[b - 1]]])
            self.codes[a:b] = spans.hashes(self.start[a:b] - self.start[a], stop[a:b] - self.start[a])
            a = b
        self.spans = Spans(self.codes)

    def words(self) -> tuple[pa.Array, np.ndarray]:
        """(the different words, the end mark an empty one; which of them each token is)."""
        different = tokens_of(self.data, np.append(self.start, len(self.data))).dictionary_encode()
        return bare(different.dictionary), different.indices.to_numpy()

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths) of all contexts of FIRST words."""
        at = np.nonzero(self.place >= FIRST)[0]
        return at, np.full(len(at), FIRST)

    def longer(self, open_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths) of the longer contexts at these places, the shorter before the longer."""
        at, lengths, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 2 * FIRST
        while len(open_at := open_at[self.place[open_at] >= k]):
            at.append(open_at)
            lengths.append(np.full(len(open_at), k))
            k *= 2
        return np.concatenate(at), np.concatenate(lengths)

    def records(self, at: np.ndarray, lengths: np.ndarray) -> Records:
        return Records(self.spans.hashes(at - lengths, at) & CONTEXT, (self.codes[at] >> np.uint64(64 - NEXT_BITS)).astype(np.uint32), self.learnt[at])


class Records:
    """Different (context, next) of some places, in order, with the number of learners and which of them a place has."""

    def __init__(self, ctx: np.ndarray, nxt: np.ndarray, n: np.ndarray):
        low = np.uint64((1 << len(ctx).bit_length()) - 1)
        key = np.sort((ctx & ~low) | np.arange(len(ctx), dtype=np.uint64))  # places ride in the low bits
        order, key = (key & low).astype(np.int64), key & ~low
        near = np.concatenate(([False], key[1:] == key[:-1]))[: len(key)]
        tied = np.nonzero(near | np.append(near[1:], False)[: len(key)])[0]  # only these are not in order yet
        order[tied] = order[tied][np.lexsort((nxt[order[tied]], ctx[order[tied]]))]
        c, x = ctx[order], nxt[order]
        same = np.concatenate(([False], c[1:] == c[:-1]))[: len(c)]
        new = ~same | np.concatenate(([True], x[1:] != x[:-1]))[: len(c)]
        at = np.nonzero(new)[0]
        self.ctx, self.nxt = c[at], x[at]
        self.n = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def counts(self) -> np.ndarray:
        """A row for each: its learners, those of its context, and how many tokens follow that; zeros where it isn't kept."""
        out = np.zeros((len(self.ctx), 3), np.int64)
        opens = np.concatenate(([True], self.ctx[1:] != self.ctx[:-1]))[: len(self.ctx)]
        at, of = np.nonzero(opens)[0], np.cumsum(opens) - 1
        if len(at):
            rows = np.nonzero((np.maximum.reduceat(self.n, at) >= SUPPORT)[of])[0]
            of = of[rows]
            out[rows, 0] = self.n[rows]
            out[rows, 1] = np.add.reduceat(self.n, at)[of]
            out[rows, 2] = np.add.reduceat((self.n > 0).astype(np.int64), at)[of]
        return out


def _bytes(x: np.ndarray, kind) -> bytes:
    """The lowest bytes of all numbers, then the next: high ones are zero and cost next to nothing."""
    return np.ascontiguousarray(x.astype(kind).reshape(-1, 1).view(np.uint8).T).tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _short(x: np.ndarray) -> bytes:
    """As _bytes(), without the high bytes that are zero in all; before them, how many each number has."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8)[:, :width].T).tobytes()


def _from_short(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(kind).ravel()


# shuffled ------------------------------------------------------------------------------------------------------------
ASKED = "chunk long, bucket int, ctx binary, nxt binary, n binary"


def _asked(chunk: int, r: Records, bits: int) -> pd.DataFrame:
    bucket = (r.ctx >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(r.ctx), np.int64)
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    some = [(b, slice(x, y)) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
    columns = {"ctx": [_short(np.diff(r.ctx[s] >> np.uint64(8), prepend=np.uint64(0))) for _, s in some], "nxt": [_short(r.nxt[s]) for _, s in some], "n": [_short(r.n[s].astype(np.uint32)) for _, s in some]}
    return pd.DataFrame({"chunk": chunk, "bucket": [b for b, _ in some], **columns})


def _ask_first(bits: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            for c in batch.itertuples():
                chunk = Chunk(c.size, c.packed, c.held)
                yield _asked(c.chunk, chunk.records(*chunk.first()), bits)

    return ask


def _ask_longer(bits: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            for c in batch.itertuples():
                chunk = Chunk(c.size, c.packed, c.held)
                at, lengths = chunk.first()
                got = replies(c.first, chunk.records(at, lengths))
                yield _asked(c.chunk, chunk.records(*chunk.longer(at[got[2] > 1])), bits)

    return ask


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """What all chunks ask of one range of hashes: counts in the order asked, nothing where all are zero."""
    give_back()
    ctx = [np.cumsum(_from_short(x, np.uint64), dtype=np.uint64) << np.uint64(8) for x in rows["ctx"]]
    cuts = np.cumsum([0, *map(len, ctx)]).tolist()
    ctx = np.concatenate(ctx)
    r = Records(ctx, np.concatenate([_from_short(x, np.uint32) for x in rows["nxt"]]), np.concatenate([_from_short(x, np.uint32) for x in rows["n"]]))
    del ctx
    counts = r.counts()
    out = [_kept(counts, r.of[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "size": np.diff(cuts), "kept": [k for k, _ in out], "counts": [x for _, x in out]})


def _kept(counts: np.ndarray, of: np.ndarray) -> tuple[int, bytes | None]:
    """How many of the contexts of these places are kept; where they are, and their counts."""
    at = np.nonzero(counts[:, 1][of])[0]
    return len(at), pa.compress(_bytes(np.concatenate((np.diff(at, prepend=0), counts[of[at]].T.ravel())), np.uint64), "zstd", asbytes=True) if len(at) else None


def _answers(asked: DataFrame) -> DataFrame:
    return asked.groupBy("bucket").applyInPandas(_answer, "chunk long, bucket int, size int, kept int, counts binary")


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "size", "kept", "counts"))).alias(name))


def replies(answers, r: Records) -> np.ndarray:
    """Learners of a place's next token, of its context, and how many tokens follow that: zeros where it isn't kept."""
    at, counts, first = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.uint64)], 0
    for x in answers if isinstance(answers, (list, np.ndarray)) else []:
        if x["counts"] is not None:
            part = _numbers(pa.decompress(x["counts"], 32 * x["kept"], "zstd", asbytes=True), np.uint64).reshape(4, -1)
            at.append(first + np.cumsum(part[0].astype(np.int64)))
            counts.append(part[1:])
        first += x["size"]
    assert first == len(r.ctx), "a chunk is not what was asked of"
    of = np.full(len(r.ctx), -1, np.int32)
    of[np.concatenate(at)] = np.arange(sum(map(len, at)))
    of = of[r.of]
    kept = np.nonzero(of >= 0)[0]
    got = np.zeros((3, len(r.of)))
    got[:, kept] = np.concatenate(counts, axis=1)[:, of[kept]]
    return got


def answered(packed: DataFrame, write) -> DataFrame:
    """The chunks with the answers to their contexts (first, longer), for blended(); ``write`` writes a table down."""
    total = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, (int(total) - 1) // RANGE).bit_length()
    first = write(_answers(packed.mapInPandas(_ask_first(bits), ASKED)))
    asked = packed.select("chunk", "held", "size", "packed").join(_by_chunk(first, "first"), "chunk", "left")
    longer = write(_answers(asked.mapInPandas(_ask_longer(bits), ASKED)))
    both = _by_chunk(first, "first").join(_by_chunk(longer, "longer"), "chunk", "left")
    return packed.join(both, "chunk", "left")


def blended(chunk: Chunk, first, longer) -> tuple[np.ndarray, np.ndarray]:
    """For each token ``a`` and ``b``, from the answers: its probability is a + b times that without words before it."""
    a, b = np.zeros(len(chunk.codes)), np.ones(len(chunk.codes))
    at, lengths = chunk.first()
    got = replies(first, chunk.records(at, lengths))
    _blend(a, b, at, got)
    at, lengths = chunk.longer(at[got[2] > 1])
    got = replies(longer, chunk.records(at, lengths))
    for k in np.unique(lengths):
        _blend(a, b, at[lengths == k], got[:, lengths == k])
    return a, b


def _blend(a: np.ndarray, b: np.ndarray, at: np.ndarray, got: np.ndarray) -> None:
    """(n + kinds * that of the shorter context) / (total + kinds) where the context is kept."""
    kept = got[1] > 0
    at, (n, total, kinds) = at[kept], got[:, kept]
    a[at] = (n + kinds * a[at]) / (total + kinds)
    b[at] = kinds / (total + kinds) * b[at]

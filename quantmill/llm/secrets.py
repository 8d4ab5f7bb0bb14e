"""Secret scans: three fixed kinds of matches, and strings in sensitive places that do not compress.

The method: a string is a candidate if it mixes letters and digits and a word of secrecy stands shortly before it.
Zstandard, primed with a dictionary of identifiers and words, compresses the surrounding text with and without the
candidate.  The difference is what the candidate adds.  Names, paths and repeated values add few bytes for their
length; random strings add nearly as many as their alphabet needs.  Names out of words that
the dictionary lacks add many bytes too, but use few letters often: a candidate's characters must also be spread as
evenly as those of random strings nearly are.  Both are measured before compression, and so is whether a candidate
reads as a name: most of its letters stand in parts of three or more, and most pairs of letters in these parts occur
in the dictionary's words, too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
#: Candidates: 16 characters or more of a key's alphabet, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words of secrecy; one must stand within BEFORE characters before a candidate.
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|credential|bearer|private|signature|akia", re.IGNORECASE | re.ASCII)
BEFORE, AROUND = 48, 256
#: A candidate is reported if it adds this many bytes a character or more; if its characters are spread evenly, as many as their entropy.
NOVEL = 0.8
#: Alphabets of keys, smallest first; signs between letters and digits say nothing about them.
ALPHABETS = tuple((re.compile(x), n) for x, n in ((r"[0-9A-F]+|[0-9a-f]+", 16), (r"[A-Z2-7]+", 32), (r"[0-9a-z]+|[0-9A-Z]+", 36), (r"[0-9A-Za-z]+", 62)))
SIGNS = str.maketrans("", "", "+/_=-")
#: Share of the entropy of random strings of its length and alphabet that a candidate must have, as names seldom do; and
#: share of its alphabet's bits from which its entropy is what it must add (long strings of few signs add less than NOVEL).
EVEN, SURE = 0.92, 0.9
#: Parts of names: letters between signs and digits, cut where small letters end and capitals begin.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A name has this share of its letters in parts of three or more, and this share of their pairs known.
IN_PARTS, KNOWN_PAIRS = 0.7, 0.68
#: Identifiers and words that occur around code and configuration: what priming makes cheap.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer "
    "credentials signature username user_name hostname localhost http https www example com org net index config settings environment "
    "default value string number integer boolean true false null none return function class import export from public static void const "
    "self this request response header content type length encoding utf8 base64 sha256 md5 version release build test debug error warning "
    "account action address admin agent alert application argument array asset async attribute audio backup batch block branch buffer button byte cache calendar callback category channel character check child chunk class click cluster "
    "collection column command comment commit component condition connection constant container context control controller cookie counter country create cursor customer dashboard database date delete deploy device dictionary directory "
    "document domain download driver editor element email endpoint entity entry event exception execute expire extension factory feature field file filter folder format frame gateway global graph group handler hash hidden history image "
    "implementation input instance interface internal invoice item iterator language layout library limit link list listener loader local location logger login lookup manager master matrix member memory menu message metadata method metric "
    "migration model module monitor mutex name network node notification object offset operation operator option order output owner package page parameter parent parser partition path payload payment permission pipeline pixel platform plugin "
    "pointer policy pool port prefix preview primary priority process product profile program project property protocol provider proxy query queue reader record reference region register remote render report repository resource result "
    "role root route router row runtime sample scheduler schema scope screen script search section select sender sequence serializer server service session shared signal size source stack state status storage stream structure style "
    "subject submit suffix summary switch symbol system table target task template temporary terminal theme thread ticket timeout timestamp title transaction transform trigger update upload user util validator variable vector view widget window worker wrapper writer "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ the and for that with this from have not are was were been "
).encode()


PAIRS = frozenset(w[i : i + 2] for w in IDENTIFIERS.decode().split() if w.isalpha() and len(w) < 20 for i in range(len(w) - 1))


def reads_as_name(candidate: str) -> bool:
    """Whether a candidate is made of parts that are spelt as the dictionary's words are."""
    parts = [p.lower() for p in PART.findall(candidate) if len(p) >= 3]
    letters, held = sum(map(str.isalpha, candidate)), sum(map(len, parts))
    pairs = [p[i : i + 2] for p in parts for i in range(len(p) - 1)]
    return held >= IN_PARTS * letters and sum(x in PAIRS for x in pairs) >= KNOWN_PAIRS * len(pairs)


class Novelty:
    """Bytes that a candidate adds to its surroundings."""

    def __init__(self):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def of(self, before: str, candidate: str, after: str) -> int:
        around = before.encode() + b"\n" + after.encode() + b"\n"
        size = lambda x: len(self.compressor.compress(around + x))
        least = size(candidate.encode())
        if candidate.isupper():  # names in capitals add no more than small ones
            least = min(least, size(candidate.lower().encode()))
        return least - size(b"")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three fixed kinds, in order."""
    found, low = [], None
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.encode().lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache(maxsize=1 << 14)
def random_entropy(size: int, n: int) -> float:
    """Expected bits a character of the counts of ``n`` random characters out of ``size``."""
    term = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - k * math.log(size) + (n - k) * math.log1p(-1 / size))
    spread = 12 * math.sqrt(n / size) + 12
    return -sum(size * term(k) * (k / n) * math.log2(k / n) for k in range(1, min(n, int(n / size + spread)) + 1))


def needed(candidate: str, least: float = NOVEL) -> float:
    """Bytes a character that a candidate must add: ``least``, or its entropy if that is nearly all its alphabet has; infinite for uneven ones."""
    plain = candidate.translate(SIGNS)
    size, n = next((n for kind, n in ALPHABETS if kind.fullmatch(plain)), 62), len(plain)
    entropy = math.log2(n) - sum(k * math.log2(k) for k in Counter(plain).values()) / n
    if entropy < EVEN * random_entropy(size, n):
        return math.inf
    return min(least, entropy / 8) if entropy >= SURE * math.log2(size) else least


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVEL) -> list[tuple[int, int, int]]:
    """Incompressible candidates in sensitive places that overlap no span of ``base``."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        x = m.group()
        if x.isalpha() or x.isdigit() or not any(map(str.isdigit, x)) or not any(map(str.isalpha, x)):
            continue
        if reads_as_name(x) or any(s < b and a < e for s, _, e in base) or not SENSITIVE.search(text, max(0, a - BEFORE), a):
            continue
        if novelty.of(text[max(0, a - AROUND) : a], x, text[b : b + AROUND]) >= needed(x, least) * len(x):
            found.append((a, 3, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    novelty = Novelty()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            more = novel_spans(text, base, novelty)
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id of any type, text): counts by kind, spans as kind:start:end in code points.

    Nothing is shuffled.  Null texts count as empty, and have no spans; null and repeated ids stay as they are, other
    columns are not read.  Texts of any length are scanned as a whole.  Of a novel span and one of the fixed kinds that
    overlap (ties), the fixed one stays.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document with the secrets in its text; odd rows as in scan_secrets()."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

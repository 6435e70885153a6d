"""Token counts of a byte-level BPE vocabulary with the whole-token shortcut.

Offline, once per vocabulary: every entry is run through the merges; those that come out as one token are the
proven whole tokens. Counting then looks pre-tokens up in that set and merges only the rest. Vocabulary-sized
tables are broadcast (bounded by the vocabulary, whatever the corpus).
"""

from __future__ import annotations

import functools
import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of counted chunks; a full cache is emptied (only speed depends on it).
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = {b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


def merge(parts: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte pair encoding: the pair of lowest rank merges first, the leftmost of equal ones."""
    while len(parts) > 1:
        best = min(((ranks.get(p), p) for p in zip(parts, parts[1:]) if p in ranks), default=None)
        if best is None:
            break
        a, b = best[1]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def merged_count(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Number of tokens that ``merge`` yields; after a merge only the two pairs beside it are looked up again."""
    parts = [data[i : i + 1] for i in range(len(data))]
    none = len(ranks)
    get = ranks.get
    order = [get(p, none) for p in zip(parts, parts[1:])]
    while order:
        best = min(order)
        if best == none:
            break
        i = order.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del order[i]
        if i:
            order[i - 1] = get((parts[i - 1], parts[i]), none)
        if i < len(order):
            order[i] = get((parts[i], parts[i + 1]), none)
    return len(parts)


def merged_long(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """As ``merge``, for long pre-tokens: a heap over a linked list, so the time is not quadratic."""
    import heapq

    part: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
    n = len(part)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (part[i], part[i + 1])) in ranks]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = nxt[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        left -= 1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (p := (part[i], part[nxt[i]])) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if prv[i] >= 0 and (p := (part[prv[i]], part[i])) in ranks:
            heapq.heappush(heap, (ranks[p], prv[i], p))
    return left


@functools.lru_cache(maxsize=2)
def proven_vocabulary(path: str) -> tuple[frozenset[str], dict[tuple[bytes, bytes], int], tuple[str, ...]]:
    """Whole tokens as text, merge ranks over bytes, special strings of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = byte_alphabet()
    raw = lambda s: bytes(byte[c] for c in s)
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
    ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    whole = set()
    for entry in spec["model"]["vocab"]:
        if any(c not in byte for c in entry):
            continue
        data = raw(entry)
        if len(merge([data[i : i + 1] for i in range(len(data))], ranks)) == 1:
            try:
                whole.add(data.decode("utf-8"))
            except UnicodeDecodeError:  # a piece of a character: it never is a whole pre-token
                continue
    return frozenset(whole), ranks, tuple(t["content"] for t in spec["added_tokens"] if t["special"])


class Chunks(dict):
    """Tokens of a chunk between two spaces, counted on its first look-up."""

    def __init__(self, counter: Counter, lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, chunk: str) -> int:
        n = self.counter.pre_tokens(self.lead + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


class Counter:
    def __init__(self, whole: frozenset[str], ranks: dict, special: tuple[str, ...]):
        self.whole, self.ranks = whole, ranks
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.double_space = regex.compile(r"\s\s").search
        self.first, self.later = Chunks(self, ""), Chunks(self, " ")

    def pre_tokens(self, text: str) -> int:
        whole, n = self.whole, 0
        for t in self.split(text):
            if t in whole:
                n += 1
            else:
                data = t.encode("utf-8", "surrogatepass")
                n += merged_count(data, self.ranks) if len(data) < 48 else merged_long(data, self.ranks)
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        # Pre-tokens never cross a space that stands alone, so chunks between such spaces count on their own.
        if self.double_space(text):
            return self.pre_tokens(text)
        head, *rest = text.split(" ")
        return self.first[head] + sum(map(self.later.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    No begin, end or template tokens; special strings inside a text are one token each, as the library has it
    by default. Null and empty texts have 0 tokens. Repeated rows and null ids give one row each; other columns
    are not read; an empty table gives an empty result. No shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tables = spark.sparkContext.broadcast(proven_vocabulary(tokenizer_path))
    key = hash(tokenizer_path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*tables.value)
        return texts.map(_COUNTERS[key].count).astype("int64")

    text = text_or_empty(text_col)
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Best-fit packing of tokenised documents with certified bin counts.

Pieces go to groups of bounded size. A group runs best-fit decreasing and bounds its bins from below by dual
feasible functions; a group that meets its bound is certified. Groups with gaps release the documents of their
least-filled bins, certified groups release one such bin, and what was released is dealt anew to fewer groups
and packed again. Rows are narrow (no token ids): ids are made, digested and dropped inside the tokenising task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, stage, text_or_empty
from .token_counts import byte_alphabet

GROUP_PIECES = 65_536
ROUNDS = 4
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64
#: Letters beyond ASCII that NFC leaves alone and that lower-case one by one.
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
PLAIN = re.compile(f"[\n -~{LETTERS}]*").fullmatch
#: The split pattern of this vocabulary for lower-cased PLAIN texts. Letters come first, as most words are of them;
#: no other alternative starts with a letter.
WORDS = re.compile(f"[a-z{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z0-9{LETTERS}]+").findall


class Recent(dict):
    """A cache of two generations: a full young one becomes the old one, and what is asked for again comes back.

    Memory is bounded by twice CACHE_ENTRIES of up to CACHE_CHARS characters, whatever the corpus.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class TextIds:
    """Packed little-endian ids of a text, as the library gives them.

    The vocabulary lower-cases, drops white space and never joins text across it. In texts of PLAIN characters
    its words are found by WORDS, and each word is merged by the library's model on its first look-up. Other
    texts are cut at spaces, and chunks that are not plain go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.signs = {b: c for c, b in byte_alphabet().items()}
        self.words, self.chunks = Recent(self.word), Recent(self.chunk)

    def word(self, word: str) -> bytes:
        signs = word if word.isascii() else "".join(map(self.signs.__getitem__, word.encode()))
        return np.asarray([t.id for t in self.merge(signs)], dtype="<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        if PLAIN(chunk) and "<|" not in chunk:
            return self.plain(chunk)
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS(text.lower())))

    def forget(self) -> None:
        """Empties the caches; a worker that waits would keep them beside the next job's tables."""
        for cache in (self.words, self.chunks):
            cache.clear()
            cache.old = {}

    def document(self, text: str) -> bytes:
        if PLAIN(text) and "<|" not in text:
            return self.plain(text)
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))


_IDS: dict[str, TextIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document is its ids, then ``end_id``."""
    bounded_batches(docs.sparkSession)
    end, step = np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _IDS.get(tokenizer_path) or _IDS.setdefault(tokenizer_path, TextIds(tokenizer_path))
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = ids.document(text) + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object})
        ids.forget()
        give_back()

    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        text_or_empty(text_col).alias("text"),
    )
    made = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions f0 (threshold) and u_k.

    f0 with threshold t: lengths over capacity - t count as a whole bin, lengths under t as nothing.
    u_k: a length x counts x(k+1)/C if that is whole, else floor(x(k+1)/C), of k bins' worth.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    count_from = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    sum_upto = np.concatenate([[0], np.cumsum(sizes * counts)])
    for t in np.unique(np.concatenate([sizes[sizes <= capacity // 2], capacity - sizes[sizes > capacity // 2] + 1])):
        lo, hi = np.searchsorted(sizes, t, "left"), np.searchsorted(sizes, capacity - t, "right")
        if t <= capacity // 2:
            best = max(best, int(count_from[hi]) - (-(int(sum_upto[hi] - sum_upto[min(lo, hi)])) // capacity))
    for k in range(1, 51):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin.

    Bins of equal room are one stack; a bit set of the rooms in use gives the tightest that fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, left = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = used >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - x
        if left[b]:
            rooms[left[b]].append(b)
            used |= 1 << left[b]
    return bins, offsets, np.asarray(left, np.int64)


def released_bins(left: np.ndarray, gap: int, capacity: int) -> np.ndarray:
    """Bins whose documents are exchanged: the emptiest, until their room is that of gap + 1 bins."""
    order = np.argsort(-left, kind="stable")
    room = np.cumsum(left[order])
    n = min(int(np.searchsorted(room, (gap + 1) * capacity)) + 1, len(left)) if gap else 1
    chosen = order[:n]
    return chosen[left[chosen] > 0]


def placer(names: list[str], r: int, last: bool, capacity: int):
    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        out = pdf[names].copy()
        out["sequence_id"] = (r << 56) | (int(key[0]) << 24) | bins
        out["offset"], out["lower_bound"], out["bins"] = offsets, bound, len(left)
        out["placed"] = True if last else ~np.isin(bins, released_bins(left, len(left) - bound, capacity))
        return out

    return place


def pack(rows: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id, offset, lower_bound and bins (both of the group that placed the row) to pieces.

    ``rows`` is a staged table: its rows are dealt to groups by their place in it, so equal rows spread like others.
    Lengths are 1 to ``capacity``. Rows with equal columns are separate pieces and get places of their own.
    No piece is dropped; after the last round every row has a place. An empty table gives an empty result.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns
    placed_type = f"{kept}, sequence_id long, offset long, lower_bound long, bins long, placed boolean"
    todo, done = rows, None
    n = todo.count()
    for r in range(rounds):
        groups = max(1, -(-n // group_pieces))
        last = r == rounds - 1 or groups == 1

        dealt = todo.withColumn("_g", F.pmod(F.xxhash64(F.lit(r), F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        packed = stage(dealt.groupBy("_g").applyInPandas(placer(names, r, last, capacity), placed_type), f"packing-{r}")
        here = packed.filter("placed").drop("placed")
        done = here if done is None else done.unionByName(here)
        if last:
            break
        todo = packed.filter("NOT placed").select(*names)
        n = todo.count()
        if n == 0:
            break
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens; see ``pieces`` and ``pack``.

    Null and empty texts are the end id alone. Only documents longer than ``capacity`` are cut. Null ids and
    repeated rows are packed like others. Columns other than id and text are not read.
    """
    return pack(stage(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity)

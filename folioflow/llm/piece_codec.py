"""SentencePiece encoding and decoding with a batched Viterbi over a piece vocabulary.

The vocabulary is one of merges (BPE), whose segmentation is not the one of highest summed score, so the lattice
is searched for the only path whose neighbouring pieces stay apart under the merges: by induction over the
prefixes that path is what merging yields. Words of equal length advance together, one end position a step: the
hashes of the substrings that end there probe the sorted piece keys, a piece counts if its neighbour on the
prefix's best path stays apart from it, and the maximum over the lengths stores the backpointer.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

GAP = "▁"
LONG_WORD = 48
BLOCK_WORDS = 8192
CACHE_ENTRIES, PAIR_ENTRIES, RUN_CHARS = 1_000_000, 2_000_000, 8_000_000
#: Ids from here on stand for single characters that are no piece; they are written as bytes.
UNKNOWN = 1 << 24
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_INVERSES = np.array([pow(int(p) * pow(0x9E3779B97F4A7C15, -1, 1 << 64), -1, 1 << 64) for p in _POWERS], np.uint64)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.control = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        normal = [i for i in range(size) if not (model.is_byte(i) or i in self.control or model.is_unused(i))]
        self.id = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        if any(GAP in p.lstrip(GAP) for p in self.id):
            raise ValueError("pieces go across words")
        # Only pieces that merging yields for their own text can occur.
        reachable = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        self.longest = max(map(len, reachable))
        keys = np.array([self.key(p) for p in reachable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.id[p] for p in reachable], np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("piece keys collide")
        self.pair_codes, self.pair_apart = np.array([-1]), np.array([True])
        self.words: dict[str, bytes] = {}
        self.unit = regex.compile(f"{GAP}*[^{GAP}]+|{GAP}+").findall

    @staticmethod
    def key(piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return (2 * int((codes * _POWERS[: len(codes)]).sum()) + len(codes)) & 0xFFFFFFFFFFFFFFFF

    def merged(self, text: str) -> list[str]:
        """Merging itself: the pair of highest score first, the leftmost of equal ones."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i], part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if part[i] != a or part[j] != b or after[i] != j:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces yields the two pieces; unknown characters never merge."""
        codes = np.where((left < UNKNOWN) & (right < UNKNOWN), (left << 24) | right, -1)
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        new = np.unique(codes[self.pair_codes[at] != codes])
        if len(new):
            kept = [self.merged((a := self.pieces[c >> 24]) + (b := self.pieces[c & 0xFFFFFF])) == [a, b] for c in new.tolist()]
            if len(self.pair_codes) > PAIR_ENTRIES:
                self.pair_codes, self.pair_apart = self.pair_codes[:1], self.pair_apart[:1]
                return self.apart(left, right)
            where = np.searchsorted(self.pair_codes, new)
            self.pair_codes = np.insert(self.pair_codes, where, new)
            self.pair_apart = np.insert(self.pair_apart, where, kept)
            at = np.searchsorted(self.pair_codes, codes)
        return self.pair_apart[at]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words of one length.

        A prefix has one path at most, so the maximum over the lengths is the one that is found; words that
        have theirs leave the search of this end.
        """
        n, count = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, n).T.astype(np.int64)
        sums = np.zeros((n + 1, count), np.uint64)
        np.cumsum(codes.astype(np.uint64) * _POWERS[:n, None], axis=0, out=sums[1:])
        last = np.zeros((n + 1, count), np.int64)  # piece that ends a prefix
        back = np.zeros((n + 1, count), np.int64)  # and its length
        for end in range(1, n + 1):
            todo = np.arange(count)
            for size in sorted(range(1, min(end, self.longest) + 1), key=lambda s: abs(s - 2.5)):
                start = end - size
                key = (sums[end, todo] - sums[start, todo]) * _INVERSES[start] * np.uint64(2) + np.uint64(size)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                piece = np.where(self.keys[at] == key, self.key_ids[at], UNKNOWN + codes[end - 1, todo] if size == 1 else -1)
                wins = np.flatnonzero((piece >= 0) & ((start == 0) | (back[start, todo] > 0)))
                if start and len(wins):
                    wins = wins[self.apart(last[start, todo[wins]], piece[wins])]
                if len(wins):
                    back[end, todo[wins]] = size
                    last[end, todo[wins]] = piece[wins]
                    todo = np.delete(todo, wins)
                    if not len(todo):
                        break
        last, back = last.T, back.T
        out = []
        for w in range(count):
            ids, end = [], n
            while end:
                ids.append(int(last[w, end]))
                end -= int(back[w, end])
            out.append(ids[::-1])
        return out

    def packed(self, ids: list[int]) -> bytes:
        flat: list[int] = []
        for i in ids:
            flat += [i] if i < UNKNOWN else [self.byte_id[b] for b in chr(i - UNKNOWN).encode()]
        return np.asarray(flat, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG_WORD or w.startswith(GAP * 2):
                # Runs of gaps have pieces of equal score, which no order of pieces decides; long words are rare.
                self.words[w] = self.packed([self.id.get(p, UNKNOWN + ord(p[0])) for p in self.merged(w)])
            else:
                by_length.setdefault(len(w), []).append(w)
        for same in by_length.values():
            same.sort()
            for at in range(0, len(same), BLOCK_WORDS):
                block = same[at : at + BLOCK_WORDS]
                for w, ids in zip(block, self.viterbi(block), strict=True):
                    self.words[w] = self.packed(ids)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if GAP in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self.unit(GAP + text.replace(" ", GAP))
        return [GAP + chunk for chunk in text.split(" ")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text; new words of a run of texts are searched together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            run, size = [], 0
            while at < len(texts) and (not run or size < RUN_CHARS):
                run.append(self.units(texts[at]))
                size += len(texts[at])
                at += 1
            new = set().union(*run).difference(self.words)
            if len(self.words) > CACHE_ENTRIES:
                self.words.clear()
                new = set().union(*run)
            self.learn(new)
            out += [b"".join(map(self.words.__getitem__, units)) for units in run]
        return out

    def decode(self, data: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become the replacement character, controls nothing."""
        out, held = [], bytearray()
        for i in np.frombuffer(data, "<u4").tolist():
            if i in self.byte_of:
                held += self.byte_of[i]
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(GAP, " ")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids array<int> for every row; null and empty texts have no ids. Other columns are not read."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in codec(model_path).encode(texts.tolist())])

    return docs.select(F.col(id_col), run(text_or_empty(text_col)).alias("ids"))


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, text for every row; null and empty arrays give the empty text."""
    bounded_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: codec(model_path).decode(np.asarray(x, "<u4").tobytes()))

    return rows.select(F.col(id_col), run(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).alias("text"))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_pieces, ids_crc32, decoded_crc32 (of the decoded text in UTF-8), round_trip for every row.

    One pass: ids and texts stay in the task. Null counts as empty. A text that holds the gap sign itself comes
    back with spaces there, so round_trip is false for it.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(model_path), []
        for text, data in zip(texts, c.encode(texts.tolist()), strict=True):
            back = c.decode(data)
            rows.append((len(data) // 4, zlib.crc32(data), zlib.crc32(back.encode()), back == text))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select(F.col(id_col), run(text_or_empty(text_col)).alias("_r")).select(id_col, "_r.*")

"""Language identification with hyperdimensional n-gram profiles.

Each letter has a fixed pseudo-random vector of +1 and -1; a trigram binds (multiplies) its letters' vectors,
the first two permuted (rolled) by their place; a text bundles (sums) its trigrams; a language bundles its
texts. A text's language is the prototype of highest cosine. Vectors are functions of code points, so every
worker makes the same ones and only the prototypes (languages x DIMENSIONS) travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_of_id, give_back, text_or_empty

DIMENSIONS = 1024
#: Texts of training rows per language are taken by hash up to about this many (a bound on fitting only).
TRAIN_ROWS = 20_000
#: Labels learnt at most; a column with more distinct values than languages there are holds something else.
MOST_LABELS = 1024
FIT_TASKS = 12
UNKNOWN = "und"
BLOCK_KEYS, BLOCK_GRAMS = 400_000, 2048


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.index = np.zeros(0x110000, np.int64)  # 0: whatever is no letter
        self.items = [self._vector(32)]

    def _vector(self, code: int) -> np.ndarray:
        return np.where(np.random.default_rng(code).random(self.d) < 0.5, -1, 1).astype(np.int8)

    def keys(self, text: str) -> np.ndarray:
        """Trigrams over letters, other characters folded to one gap; empty if there is no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = self.letter[codes]
        if not is_letter.any():
            return np.empty(0, np.int64)
        seen = np.where(is_letter, self.index[codes], 0)
        if (new := is_letter & (seen == 0)).any():
            for c in np.unique(codes[new]).tolist():
                self.index[c] = len(self.items)
                self.items.append(self._vector(c))
            seen = np.where(is_letter, self.index[codes], 0)
        seen = np.concatenate([[0], seen, [0]])
        seen = seen[np.concatenate([[True], (seen[1:] != 0) | (seen[:-1] != 0)])]
        if len(seen) < 3:
            return np.empty(0, np.int64)
        return (seen[:-2] << 40) | (seen[1:-1] << 20) | seen[2:]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text (0 where it has no letter), and its number of trigrams."""
        keys = [self.keys(t) for t in texts]
        sizes = np.array([len(k) for k in keys], np.int64)
        out = np.zeros((len(texts), self.d), np.float32)
        if not sizes.sum():
            return out, sizes
        grams, place = np.unique(np.concatenate(keys), return_inverse=True)
        items = np.array(self.items)
        mask = (1 << 20) - 1
        rows = np.repeat(np.arange(len(texts)), sizes)
        for at in range(0, len(grams), BLOCK_GRAMS):
            g = grams[at : at + BLOCK_GRAMS]
            bound = np.roll(items, 2, 1)[g >> 40] * np.roll(items, 1, 1)[(g >> 20) & mask] * items[g & mask]
            here = (place >= at) & (place < at + len(g))
            counts = np.bincount(rows[here] * len(g) + place[here] - at, minlength=len(texts) * len(g))
            out += counts.reshape(len(texts), len(g)).astype(np.float32) @ bound.astype(np.float32)
        return out, sizes

    def blocks(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bundles of runs of texts, each run bounded in characters."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_KEYS or i - start >= 63 or i == len(texts) - 1:
                yield (start, *self.bundles(texts[start : i + 1]))
                start, size = i + 1, 0


_PROFILES: dict[int, Profiles] = {}


def profiles(dimensions: int) -> Profiles:
    return _PROFILES.get(dimensions) or _PROFILES.setdefault(dimensions, Profiles(dimensions))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows_per_label: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Labels in order and their prototypes, learnt from text and non-null label.

    Of a label with more rows, those whose id and text hash below a threshold are taken, ``rows_per_label`` expected.
    The MOST_LABELS most frequent labels are learnt. The driver gets FIT_TASKS rows a label at most. Of an empty table,
    or one without labels, nothing is learnt.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(label_col).alias("l")).count().orderBy(F.desc("count"), "l").limit(MOST_LABELS)
    totals = {r[0]: r[1] for r in counts.collect()}
    if not totals:
        return [], np.zeros((0, dimensions), np.float32)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(label, int(min(1.0, rows_per_label / n) * 1_000_003)) for label, n in totals.items()], "_label string, _share int")
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_003)).alias("_place"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, sums = profiles(dimensions), {}
        for batch in batches:
            labels = batch["label"].to_numpy()
            for at, vectors, sizes in p.blocks(batch["text"].tolist()):
                weighed = vectors / np.sqrt(np.maximum(sizes, 1))[:, None]
                for label in set(labels[at : at + len(sizes)]):
                    sums[label] = sums.get(label, 0) + weighed[labels[at : at + len(sizes)] == label].sum(0, dtype=np.float64)
        give_back()
        if sums:
            yield pd.DataFrame({"label": list(sums), "v": [v.tolist() for v in sums.values()]})

    sample = rows.join(F.broadcast(shares), (F.col("label") == F.col("_label")) & (F.col("_place") <= F.col("_share"))).select("label", "text")
    parts = sample.coalesce(FIT_TASKS).mapInPandas(bundle, "label string, v array<double>").collect()
    labels = sorted(map(str, totals))
    prototypes = np.zeros((len(labels), dimensions))
    for r in sorted(parts, key=lambda r: (r["label"], r["v"])):
        prototypes[labels.index(r["label"])] += r["v"]
    return labels, prototypes.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (cosine with the prototype, not below 0) to the columns ``keep`` of ``docs``.

    ``und`` with score 0: null text, no letter, or no label learnt. Long texts are bundled whole. The vector
    common to all languages is taken off the prototypes and the texts before they are compared.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast((labels, prototypes))

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        names, raw = shipped.value
        p = profiles(raw.shape[1])
        langs = unit(raw)
        shared = langs.mean(0) if len(names) > 1 else np.zeros(raw.shape[1], np.float32)
        own = unit(langs - shared)
        pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for at, vectors, sizes in p.blocks(texts.tolist()) if names else ():
            cosines = unit(unit(vectors) - shared) @ own.T
            best = cosines.argmax(1)
            for i in np.flatnonzero(sizes).tolist():
                pred[at + i], score[at + i] = names[best[i]], min(1.0, max(0.0, float(cosines[i, best[i]])))
        give_back()
        return pd.DataFrame({"lang_pred": pred, "score": score})

    out = docs.select(*[F.col(c) for c in keep or docs.columns], decide(text_or_empty(text_col)).alias("_p"))
    return out.select(*[F.col(c) for c in keep or docs.columns], "_p.lang_pred", "_p.score")


def held_out(id_col: str = "doc_id"):
    return F.pmod(crc32_of_id(id_col), F.lit(5)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred, score for every row; learns from the rows that are not held out.

    Null ids count as the empty text in the split. Repeated rows give one row each. An empty table gives an
    empty result; a table without labels gives ``und`` throughout. Of languages of equal score the first in order is
    taken.
    """
    labels, prototypes = fit(docs.filter(~held_out(id_col)), text_col, label_col, id_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, labels, prototypes, "_text", [id_col, "held_out"])

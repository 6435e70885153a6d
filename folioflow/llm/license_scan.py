"""Licence scan: winnowed fingerprints of templates pick candidates, banded word alignment reports spans.

Templates are a parameter and small; their fingerprint index travels to every task, the documents never move.
They are one-line notices, standard headers and the bodies of licences in ``licenses``; SPDX tags are read by their
own syntax, so that an id is reported as it stands.
"""

from __future__ import annotations

import pkgutil
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

GRAM, WINDOW = 3, 2
BAND = 8  # and a hundredth of the template's words
COVERAGE = 0.8
SCAN_BYTES = 1 << 20

#: Public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved. No part of this publication may be reproduced",
    "reserved-bare": "All rights reserved",
}

#: Licences whose body is a template, read on the driver from ``licenses``.
BODIES = "Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 NCSA OFL-1.1 Unlicense Zlib".split()
TEMPLATES |= {f"{n}-body": pkgutil.get_data(__package__, f"licenses/{n}.txt").decode() for n in BODIES}

_GRANT = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, "
_LATER = "either version {2} of the License, or (at your option) any later version."
_WARRANTY = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
for _name, *_values in (
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
):
    for _kind, _terms in (("or-later", _LATER), ("only", "version {2} of the License.")):
        TEMPLATES[f"{_name}-{_kind}-grant"] = (_GRANT + _terms).format(*_values)
        TEMPLATES[f"{_name}-{_kind}-header"] = (_GRANT + _terms + _WARRANTY).format(*_values)

_TAG = re.compile(rb"SPDX-License-Identifier:")
_TAG_ID = re.compile(rb"[ \t(]*([A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?(?:[ \t]+WITH[ \t]+[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)?)")
_TAG_NEXT = re.compile(rb"[ \t)]+(?:AND|OR)(?=[ \t(])", re.IGNORECASE)

#: ASCII letters lower-cased, other ASCII but digits as a gap; bytes of other scripts as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_LETTERS = np.random.default_rng(0x11CE).integers(0, 1 << 64, 4096, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word."""
    chars = np.frombuffer(data.translate(_FOLD), np.uint8)
    at = np.flatnonzero(chars != 32)
    if not len(at):
        return np.empty(0, np.uint64), at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    lengths = np.diff(np.concatenate([first, [len(at)]]))
    place = (at - np.repeat(at[first], lengths)) % len(_LETTERS)
    sums = np.add.reduceat(_LETTERS[place] * chars[at].astype(np.uint64), first)
    return mix(sums + lengths.astype(np.uint64)), at[first], at[first] + lengths


def grams_of(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = mix(out) + words[k : k + n] * np.uint64(2 * k + 3)
    return mix(out)


def winnowed(grams: np.ndarray) -> dict[int, list[int]]:
    """Places of the fingerprints: the smallest gram of each window, the rightmost of equal ones."""
    out: dict[int, list[int]] = defaultdict(list)
    for i in range(max(1, len(grams) - WINDOW + 1)) if len(grams) else ():
        window = grams[i : i + WINDOW]
        k = i + len(window) - 1 - int(np.argmin(window[::-1]))
        if k not in out[int(grams[k])]:
            out[int(grams[k])].append(k)
    return out


class Templates:
    """Word hashes of the templates and the inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str], tags: bool = False):
        self.tags = tags
        self.names = sorted(templates)
        self.words = [words_of(templates[n].encode())[0] for n in self.names]
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for g, places in winnowed(grams_of(words)).items():
                index[g] += [(t, k) for k in places]
        self.index = dict(index)
        self.prints = np.sort(np.fromiter(self.index, np.uint64, len(self.index)))

    def hits(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.prints) or not len(grams):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, grams), len(self.prints) - 1)
        return np.flatnonzero(self.prints[at] == grams)


def align(template: np.ndarray, words: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment in the band of diagonals start - band to start + band.

    Word matches score 2, replaced, missing and added words -1. Returns score, matched words and the first and
    last matched word of the document.
    """
    best = (0, 0, -1, -1)
    row: dict[int, tuple[int, int, int, int]] = {}
    low = max(0, start - band)
    text = words[low : max(0, start + len(template) + band)].tolist()
    for i, w in enumerate(template.tolist()):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, start + i - band), min(len(words), start + i + band + 1)):
            d, u, l = row.get(j - 1), row.get(j), new.get(j - 1)
            if text[j - low] == w:
                s, m, f, _ = d or (0, 0, j, j)
                cell = (s + 2, m + 1, f if m else j, j)
            else:
                cell = max(((c[0] - 1, *c[1:]) for c in (d, u, l) if c), default=None)
                if cell is None or cell[0] <= 0:
                    continue
            new[j] = cell
            if (cell[0], cell[1], -cell[3]) > (best[0], best[1], -best[3]):
                best = cell
        row = new
    return best


def most_matches(template: np.ndarray, words: np.ndarray, start: int, band: int, least: float) -> float:
    """No alignment in the band matches more words; found in steps of rising cost, until one falls short of ``least``."""
    n = len(template)
    near = words[max(0, start - band) : max(0, start + n + band)]
    if len(near) < least:
        return len(near)
    if (found := np.isin(template, near).sum()) < least:
        return found
    met = np.zeros(n, bool)
    for at in range(start - band, start + band + 1):
        low, high = max(0, -at), min(n, len(words) - at)
        if low < high:
            met[low:high] |= template[low:high] == words[at + low : at + high]
    return met.sum()


def tags(data: bytes) -> list[tuple[str, float, int, int, int]]:
    """Rows of the ids in SPDX tags, one for each id of an expression; an exception stays with its id."""
    out = []
    for tag in _TAG.finditer(data):
        at = tag.end()
        while m := _TAG_ID.match(data, at):
            out.append((" ".join(m[1].decode().split()), 1.0, len(words_of(m[1])[0]), m.start(1), m.end(1)))
            if not (more := _TAG_NEXT.match(data, m.end())):
                break
            at = more.end()
    return out


def scan(data: bytes, t: Templates, least: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) of the matches of a text, in bytes, ordered by place.

    Of matches of one template that overlap, the one of highest score; of templates over the same words, those
    that match most words. Ids in SPDX tags stand beside them if ``t`` asks for tags.
    """
    words, starts, ends = [], [], []
    at = 0
    while at < len(data):
        cut = len(data) if at + SCAN_BYTES >= len(data) else data.find(b" ", at + SCAN_BYTES)
        cut = len(data) if cut < 0 else cut
        w, s, e = words_of(data[at:cut])
        words.append(w)
        starts.append(s + at)
        ends.append(e + at)
        at = cut
    if not words:
        return []
    words, starts, ends = np.concatenate(words), np.concatenate(starts), np.concatenate(ends)
    grams = grams_of(words)
    diagonals: dict[int, set[int]] = defaultdict(set)
    for k in t.hits(grams).tolist():
        for name, place in t.index[int(grams[k])]:
            diagonals[name].add(k - place)
    found = []
    for name, places in diagonals.items():
        template = t.words[name]
        band = BAND + len(template) // 100
        last = whole = None
        for d in sorted(places):
            if last is not None and d - last <= band // 2 or whole is not None and d - whole <= band:
                continue
            last = d
            if most_matches(template, words, d, band, least * len(template)) < least * len(template):
                continue
            score, matched, first, end = align(template, words, d, band)
            coverage = matched / len(template)
            if coverage >= least:
                found.append((score, matched, first, end, name, coverage))
            # A copy word for word cannot be bettered by the diagonals beside its own.
            whole = first if score == 2 * len(template) > 2 * band else None
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[1], -m[0], m[2], m[4])):
        if all(m[3] < k[2] or m[2] > k[3] for k in kept):
            kept.append(m)
    rows = [(t.names[m[4]], m[5], m[1], int(starts[m[2]]), int(ends[m[3]])) for m in kept]
    return sorted(rows + (tags(data) if t.tags else []), key=lambda r: r[3])


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = COVERAGE) -> DataFrame:
    """One row per match: ``id_col``, license_id, coverage, matched_words, start_char, end_char (exclusive).

    coverage: matched words of the template against all its words. Without ``templates``, those of TEMPLATES and
    the ids of SPDX tags, which are license_id themselves. Null, empty and wordless texts and templates
    have no matches. Repeated rows are each scanned; null ids come back null. No shuffle, nothing but matches
    leaves the scanning task.
    """
    bounded_batches(docs.sparkSession)
    prepared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES, True) if templates is None else Templates(templates))

    @F.pandas_udf("array<struct<license_id:string,coverage:double,matched_words:int,start_char:int,end_char:int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            data = text.encode()
            out.append([(n, c, m, len(data[:s].decode()), len(data[:e].decode())) for n, c, m, s, e in scan(data, prepared.value, least)])
        return pd.Series([[dict(zip(("license_id", "coverage", "matched_words", "start_char", "end_char"), x, strict=True)) for x in row] for row in out])

    return docs.select(F.col(id_col), F.explode(run(text_or_empty(text_col))).alias("_m")).select(id_col, "_m.*")

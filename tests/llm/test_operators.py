"""Operators on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from folioflow.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, media_copies, packing, piece_codec, queries, sharding, token_counts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, kept string, unit string, token string, _id string"
BYTE, WORD, PIECE = map(queries.vocabulary, (queries.BYTE_VOCABULARY, queries.WORD_VOCABULARY, queries.PIECE_VOCABULARY))


def fixture():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    for i in range(12):  # near copies, one word changed each, of two bases
        w = (texts[0] + " " + texts[1]).split() if i % 2 else (texts[2] + " " + texts[3]).split()
        w[rng.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    line = " ".join(words[:12])
    texts += [line + "\n" + texts[5], texts[6] + "\n" + line[:-1], line[:9] + "X" + line[9:], texts[4], texts[4].replace(" ", "\t \n"), "A B", "a b", "", None, " ", "...", "é ü 日本 <|endoftext|> x", " ".join(words * 20)]
    rows = [(i, t, ("en", "de", None)[i % 3], "x", "u", "t", "i") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[45], (None, texts[4], "en", "x", "u", "t", "i"), (None, None, None, None, None, None, None)]


ROWS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(docs, empty):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_classes(docs).collect())
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert got == Counter((i, least[norm(t)], len(groups[norm(t)]), i == least[norm(t)]) for i, t, *_ in ROWS)
    assert exact_dedup.exact_classes(empty).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, BYTE).collect())
    assert got == Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)
    assert token_counts.token_counts(empty, BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab '\n\t\x1c \u0085!1é日😀<|>", "<|endoftext|>", "the", "  "]), max_size=24).map("".join))
def test_token_counts_any_text(text):
    from tokenizers import Tokenizer

    global _T, _C
    if "_T" not in globals():
        _T, _C = Tokenizer.from_file(BYTE), token_counts.Counter(*token_counts.proven_vocabulary(BYTE))
    assert _C.count(text) == len(_T.encode(text, add_special_tokens=False).ids)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, capacity=256).toPandas()
    expected = Counter()
    for i, x, *_ in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            expected[i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())] += 1
    cells = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in cells) == expected
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == list(s["length"].cumsum() - s["length"])
        assert s["length"].sum() <= 256
    assert rows["sequence_id"].nunique() <= packing.lower_bound(rows["length"].to_numpy(), 256) + 1
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_exchanges(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([30, 41, 50, 60, 77, 100]), i) for i in range(900)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces, 100, group_pieces=100).toPandas()
    assert sorted(out["doc_id"]) == list(range(900))
    assert out.groupby("sequence_id")["length"].sum().max() <= 100
    best = packing.best_fit_decreasing(np.array([r[3] for r in rows]), 100)[2]
    assert out["sequence_id"].nunique() <= len(best) + 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_a_bound(lengths):
    x = np.array(lengths, np.int64)
    best = fewest(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(x, 20) <= best <= len(packing.best_fit_decreasing(x, 20)[2])


def fewest(items, bins):
    if not items:
        return len(bins)
    options = [fewest(items[1:], sorted([*bins[:k], bins[k] + items[0], *bins[k + 1 :]])) for k in range(len(bins)) if bins[k] + items[0] <= 20 and bins[k] not in bins[:k]]
    return min([*options, fewest(items[1:], sorted([*bins, items[0]]))])


def test_language(spark, docs, empty):
    assert language_id.identify(empty).count() == 0
    rows = {r["doc_id"]: r for r in language_id.identify(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    for i, t, *_ in ROWS:
        if i is not None:
            assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
            assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
            assert 0 <= rows[i]["score"] <= 1


def test_language_accuracy(spark):
    found = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.avg(F.expr("int(lang = lang_pred)")), F.count("*")).first()
    assert n > 100
    assert right > 0.97


def test_reshard(docs, empty):
    rows = sharding.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"), 3, [1] * 5).toPandas()
    assert sorted(rows["size"]) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    for _, s in rows.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= rows["size"].max()
    assert sharding.reshard(empty, F.lit(0), 1, [1]).count() == 0


def test_flow_moves_least():
    flow = sharding.min_cost_flow([10, 0, 5], [5, 5, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert flow == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_jaccard(docs, empty):
    def shingles(t):
        w = [x for x in norm(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if t else "").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in ROWS if i is not None}
    joined = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    expected = brute_components(sorted(sets), joined)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == expected
    assert {i: r["n_shingles"] for i, r in got.items() if i is not None} == {i: len(s) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(docs).count() == len(ROWS)
    assert jaccard_join.near_duplicates(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(1, 4))
def test_band_distance(a, b, edits):
    assert line_dedup.band_distances([(a, b)], edits)[0] == min(distance(a, b), edits + 1)


def test_lines(docs, empty):
    first = {}
    for i, t, *_ in sorted((r for r in ROWS if r[0] is not None and r[1]), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (i, k))
    named = {place: line for line, place in first.items()}
    close = lambda a, b: abs(len(named[a]) - len(named[b])) <= 2 and line_dedup.band_distances([(named[a], named[b])])[0] <= 2
    roots = brute_components(sorted(named), close)
    known = docs.filter("doc_id IS NOT NULL")
    text = {r[0]: r[1] for r in ROWS}
    rows = line_dedup.line_classes(known).collect()
    for r in rows:
        root = roots[first[text[r["doc_id"]].split("\n")[r["line_no"]]]]
        assert (r["class_doc"], r["class_line"], r["kept"]) == (*root, root == (r["doc_id"], r["line_no"]))
    assert any(not r["kept"] for r in rows)
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.line_classes(empty).count() == 0


def test_copies_of_short_lines(spark, tmp_path):
    texts = ["Les.\n\nLet.\nA line of its own", "Les.\n\nx", "x\nLes", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["kept"]) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (0, 0, True), (0, 2): (0, 2, True), (0, 3): (0, 3, True), (1, 0): (0, 0, False), (1, 2): (1, 2, True), (2, 0): (1, 2, False), (2, 1): (2, 1, True)}
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(rows).collect()}
    assert left == {0: texts[0], 1: "\nx", 2: "Les", 3: None}


def changed_lines():
    """Lines of 40 to 3500 characters, each with copies changed in one word, two words and some more characters."""
    rng = random.Random(3)
    out = []
    for n in (40, 140, 149, 150, 153, 330, 430, 900, 1700, 3500):
        line = ""
        while len(line) < n:
            line += "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) + " "
        out.append(line[:n])
        for words in (1, 2, 6):
            w = line[:n].split(" ")
            for k in rng.sample(range(len(w) - 1), words):
                w[k] = "".join(rng.choice("klmn") for _ in range(len(w[k]) + rng.randint(-1, 1)))
            out.append(" ".join(w))
        for edits in (2, n // 50, n // 50 + 1):
            chars = list(line[:n])
            for k in range(edits):  # spread evenly, which leaves the shortest runs
                chars[(k + 1) * n // (edits + 1) - 1] = "z"
            out.append("".join(chars))
    return out


def test_edits_grow_with_length(spark, tmp_path):
    lines = changed_lines()
    allowed = lambda a, b: max(2, min(len(a), len(b)) // 50)
    close = lambda a, b: abs(len(lines[a]) - len(lines[b])) <= allowed(lines[a], lines[b]) and line_dedup.wide_distance(lines[a], lines[b]) <= allowed(lines[a], lines[b])
    roots = brute_components(list(range(len(lines))), close)
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_doc"] for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == roots
    assert [got[7 * i + 1] for i in (6, 7, 8, 9)] == [42, 49, 56, 63]  # one word
    assert [got[7 * i + 2] for i in (7, 8, 9)] == [49, 56, 63]  # two words
    assert sum(i == r for i, r in roots.items()) > 20


@settings(max_examples=100, deadline=None)
@given(st.text("abé", max_size=60), st.text("abé", max_size=60), st.integers(5, 30))
def test_distances_of_wide_bands(a, b, edits):
    assert line_dedup.wide_distance(a, b) == distance(a, b)
    assert line_dedup.band_distances([(a, b)], edits)[0] == min(distance(a, b), edits + 1)


def test_licenses(docs, empty):
    t = license_scan.Templates(license_scan.TEMPLATES)
    for name, notice in license_scan.TEMPLATES.items():
        text = f"Some words before é.\n{notice}. And more words."
        found = license_scan.scan(text.encode(), t)
        assert any(f[0] == name and f[1] == 1.0 for f in found)
        n, _, _, start, end = next(f for f in found if f[0] == name)
        assert text.encode()[start:end].decode() in text
    changed = license_scan.TEMPLATES["MIT-text"].replace("granted", "given").encode()
    assert [f[0] for f in license_scan.scan(changed, t)] == ["MIT-text"]
    assert license_scan.license_matches(docs).count() == 0
    assert license_scan.license_matches(empty).count() == 0
    assert license_scan.license_matches(docs, {}).count() == 0


def test_licence_lines_that_are_no_copies_of_templates(spark):
    header = "This file is part of Foo.\n# Foo is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation; either version {} of the License, or\n# (at your option) any later version."
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + license_scan.TEMPLATES["MIT-body"].replace("the Software", "this program")
    gpl = license_scan.TEMPLATES["GPL-2.0-body"].split()
    for at in range(150, len(gpl), 160):  # a page break each
        gpl.insert(at, "Page")
    texts = {
        "Prose.\nAll rights reserved.\nMore prose.": ["reserved-bare"],
        "All rights reserved. No part of this book may be reproduced": ["reserved"],
        header.format("", 3): ["GPL-3.0-or-later-grant"],
        header.format("", 2): ["GPL-2.0-or-later-grant"],
        header.format("Lesser ", "2.1"): ["LGPL-2.1-or-later-grant"],
        mit: ["MIT-body"],
        " ".join(gpl): ["GPL-2.0-body"],
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) */": ["MIT", "GPL-2.0-only WITH Classpath-exception-2.0"],
        "# SPDX-License-Identifier: Zlib. Prose and MIT": ["Zlib"],
        "All right, he reserved a table. The terms of the license are in the software and the work of the author": [],
    }
    rows = license_scan.license_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, (text, names) in enumerate(texts.items()):
        found = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start_char"])
        assert [r["license_id"] for r in found] == names, text[:80]
        assert all(0 <= r["start_char"] < r["end_char"] <= len(text) for r in found)


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids = piece_codec.encode(docs, PIECE)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((i, tuple(sp.encode(t or ""))) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["text"]) for r in piece_codec.decode(ids, PIECE).collect()) == Counter((i, t or "") for i, t, *_ in ROWS)
    assert piece_codec.round_trip(empty, PIECE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab \n▁é日😀1.", "the", "ing", "  "]), max_size=20).map("".join))
def test_pieces_any_text(text):
    import sentencepiece

    global _S
    if "_S" not in globals():
        _S = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    c = piece_codec.codec(PIECE)
    data = c.encode([text])[0]
    assert np.frombuffer(data, "<u4").tolist() == _S.encode(text)
    assert c.decode(data) == _S.decode(_S.encode(text))


def test_media(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=16).tolist() for _ in range(6)]
    rows = [(i, vectors[i % 6]) for i in range(15)] + [(15, None)]
    media = media_copies.with_images(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r["vec_id"]: r for r in media_copies.media_classes(media, "vec_id", "image").collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {i: i % 6 if i < 15 else 15 for i in range(16)}
    assert got[15]["n_corners"] == 0
    odd = spark.createDataFrame([(1, b"junk"), (2, b"junk"), (3, b"")], "vec_id long, image binary")
    assert {r["vec_id"]: r["class_id"] for r in media_copies.media_classes(odd, "vec_id", "image").collect()} == {1: 1, 2: 1, 3: 3}


def test_word_ids_equal_the_library():
    """Plain texts, contractions, case, composed and combining letters, special strings and their upper case."""
    found = packing.TextIds(WORD)
    texts = ["", " ", "It's WE'LL i'M 'Tis 2048 a1b2", "Straße ÀÉ Œuvre Ÿ ž", "T̈ é İ ſ ΑΣ ς", "<|endoftext|> <|ENDOFTEXT|> a<|b", "x\ty\r\nz w", "漢字 한글 👍", "a" * 5000, "...!!,,'s's"]
    for text in texts * 2:  # the second time from the cache
        assert found.document(text) == np.asarray(found.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

"""Rows that must not get lost: null and repeated ids, empty partitions, emptied shards, hot lists."""

import random

import corpus_pipeline
from folioflow.llm import exact_dedup, jaccard_join, language_id, line_dedup, media_copies, packing, queries, sharding
from folioflow.llm.common import stage
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def chain():
    """Texts A, M, C: A and C link with M only."""
    w = words(random.Random(5), 100)
    a, c = list(w), list(w)
    for i in (0, 1, 50):
        a[i] = f"x{i}"
    for i in (20, 70, 99):
        c[i] = f"y{i}"
    return " ".join(a), " ".join(w), " ".join(c)


def test_null_ids_bridge(spark):
    a, m, c = chain()
    assert jaccard_join.parities_apart(jaccard_join.parity(jaccard_join.shingles(a.encode())), jaccard_join.parity(jaccard_join.shingles(m.encode()))) <= len(set(jaccard_join.shingles(a.encode())) ^ set(jaccard_join.shingles(m.encode())))
    for middle in (7, None):
        rows = spark.createDataFrame([(1, a), (middle, m), (2, c), (None, None)], SCHEMA)
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.near_duplicates(rows).collect()}
        assert got == {(1, 96): 1, (middle, 96): 1, (2, 96): 1, (None, 0): None}


def test_lists_of_unlinked_members(spark):
    """A passage in many documents that link with nothing: rows of the join of lists do not grow with its square."""
    rng = random.Random(9)
    shared = words(rng, 12)
    rows = spark.createDataFrame([(i, " ".join([*words(rng, 30), *shared, *words(rng, 30)])) for i in range(120)], SCHEMA)
    got = jaccard_join.near_duplicates(rows).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 120


def test_exact_copies_by_id_and_text(spark):
    rows = spark.createDataFrame([(1, "a b"), (None, "a b"), (None, "unique"), (5, "a\tb"), (5, "other")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_exact_copies(rows).collect()) == [(0, "unique"), (1, "a b"), (5, "other")]


def test_rewrite_keeps_each_row_once(spark, tmp_path):
    rng = random.Random(2)
    data = [(None if i % 50 == 0 else i % 390, " ".join(words(rng, rng.randint(1, 40))), "s") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string")
    out = f"{tmp_path}/layout"
    count = lambda: sorted((r["doc_id"] or -1, r["text"]) for r in spark.read.option("recursiveFileLookup", "false").parquet(out).collect())
    expected = sorted((r[0] or -1, r[1]) for r in data)
    docs.withColumn("shard", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4)).cast("int")).write.partitionBy("shard").parquet(out)
    old = 4
    for new in (2, 5, 3):
        here = spark.read.parquet(out)
        plan = stage(sharding.reshard(here, F.col("shard"), old, [1] * new), "plan")
        touched = sharding.rewrite(spark, here, plan, out)
        assert touched and count() == expected
        sizes = {r["shard"]: r["n"] for r in spark.read.parquet(out).groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
        assert sizes == {r["shard"]: r["n"] for r in plan.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        old = max(old, new)


def test_null_ids_spread_over_shards(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(None if i % 4 else i, " ".join(words(rng, 20))) for i in range(2000)], SCHEMA)
    sizes = [r["n"] for r in sharding.reshard(rows, F.lit(0), 4, [1] * 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_language_of_few_rows_in_many_partitions(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lief in den wald", "en" if i % 2 else "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12)
    got = language_id.identify(docs).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got} <= {"en", "de"}


def naive_bundle(p, text):
    """Sum of the bound vectors of a text's letter trigrams, one at a time."""
    return p.bundles([text])[0][0]


def test_language_bundles_add_up(spark):
    p = language_id.profiles(256)
    texts = ["alpha beta", "gamma delta epsilon", "zeta"]
    both = p.bundles(texts)[0]
    assert all((both[i] == naive_bundle(p, t)).all() for i, t in enumerate(texts))


def test_equal_pieces_are_dealt(spark):
    rows = stage(spark.range(3000).select(F.lit(None).cast("string").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32")).repartition(4), "pieces")
    packed = packing.pack(rows, 64, group_pieces=200, rounds=2).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"), F.max("bins").alias("bins")).collect()
    assert sum(r["n"] for r in packed) == 3000 and max(r["last"] for r in packed) < 64 and max(r["bins"] for r in packed) < 12


def test_pipeline_stages_tell_rows_apart(spark):
    a, m, _ = chain()
    rows = spark.createDataFrame([(1, m), (None, m), (3, m), (3, "another text"), (4, a), (3, m)], SCHEMA)
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, m), (3, "another text")]
    again = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(1, m), (1, m), (None, None), (None, "")], SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in again) == [(0, ""), (0, ""), (1, m)]


def test_pipeline_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text here", None, 5), (2, "some other words", None, 6)], "doc_id long, text string, lang string, _row int")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 2
    nothing = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, "").count() == 0


def test_grams_meet_at_like_places_only(spark, tmp_path):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase = word(60)
    lines = [word(20 * i) + phrase + word(540 - 20 * i) for i in range(12)]  # one length, one passage, places 20 apart
    docs = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    lists = lambda rows: line_dedup.shared_keys(line_dedup.parcels(docs(rows), "text", 2, 32, 2, frozenset(), 1), 2, 2).filter("token IS NOT NULL")
    assert lists(lines).count() == 0
    assert lists([word(100) + phrase[:20] + word(480) for _ in range(8)]).count() == 0  # one place, but nothing beside
    near = []
    for i, line in enumerate(["-" * 400, "ab" * 150, word(9) + "=" * 260 + word(9), *lines[:4], word(7000), "x" * 300 + word(40)]):
        k = len(line) // 50
        near += [line, "q" * (k // 2) + line[: len(line) - k // 4 - 1] + "z", line[k:], line[: 30 + i] + "yy" + line[30 + i :]]
    docs(near).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_doc"] for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    limit = lambda a, b: max(2, min(len(a), len(b)) // 50)
    want = list(range(len(near)))
    for _ in range(3):
        for a in range(len(near)):
            for b in range(len(near)):
                if abs(len(near[a]) - len(near[b])) <= (m := limit(near[a], near[b])) and line_dedup.wide_distance(near[a], near[b]) <= m:
                    want[a] = min(want[a], want[b])
    assert got == dict(enumerate(want))


def test_keys_travel_in_small_frames(spark):
    """What a worker gathers before it ships is bounded: two of them and the heap share an executor."""
    rng = random.Random(3)
    parts = [f"{rng.getrandbits(1000):0250x}" for _ in range(2000)]
    lines = "\n".join(parts[i] + parts[(i * 7 + j) % 2000] for j in range(1, 11) for i in range(2000))
    docs = spark.createDataFrame([(1, lines)], SCHEMA).coalesce(1)
    sizes = [r["n"] for r in line_dedup.parcels(docs, "text", 2, 32, 2, frozenset(), 1).select(F.octet_length("keys").alias("n")).collect()]
    assert sum(sizes) > 17 * 600_000 and max(sizes) < 17 * 600_000


def test_packing_leaves_no_words_in_waiting_workers(spark):
    import pandas as pd

    made, real = [], spark.createDataFrame([(1, "x")], SCHEMA)

    class Rows:
        sparkSession, schema = spark, real.schema
        select = lambda self, *_: self
        mapInPandas = lambda self, f, _: made.append(f) or real

    packing.pieces(Rows(), queries.vocabulary(queries.WORD_VOCABULARY))
    assert len(list(made[0](iter([pd.DataFrame({"doc_id": ["1"], "text": ["some words"]})])))) == 1
    assert packing._IDS and not any(x.words or x.words.old for x in packing._IDS.values())


def test_views_of_one_scene_travel_once(spark):
    """Descriptors do not travel with every pair of a scene's views."""
    rows = [(i, [1.0] * 16) for i in range(200)] + [(200, [-1.0] * 16)]
    media = stage(media_copies.with_images(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)), "views")
    shuffled = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])
    before = shuffled()
    got = {r["vec_id"]: r["class_id"] for r in media_copies.media_classes(media, "vec_id", "image").collect()}
    assert got == {i: 0 if i < 200 else 200 for i in range(201)}
    assert shuffled() - before < 5_000_000

"""Driver queries of the training-data operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, media_copies, packing, piece_codec, sharding, token_counts
from .common import table

BYTE_VOCABULARY, WORD_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SHARDS, OLD_SHARDS = 16, 12


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout has a shard for each class of sources, so its sizes are uneven."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))
    made = sharding.reshard(docs, old, OLD_SHARDS, [1] * SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are rendered from the vectors: vectors of one scene are edited views of it."""
    media = media_copies.with_images(table(spark, sf_dir, "embeddings"))
    return media_copies.media_classes(media, "vec_id", "image")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), shortest=line_dedup.SHORTEST, percent=line_dedup.EDIT_PERCENT)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_jaccard_join": OP9_SQL}

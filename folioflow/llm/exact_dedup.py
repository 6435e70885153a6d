"""Exact deduplication: 128-bit content hash groups, bytes compared inside the groups. JVM side only.

Plan: one scan makes a narrow digest table (id, md5, sha256). md5 groups of one row are done. Only texts of
groups with several rows are read again and grouped by (md5, text): the aggregate compares the bytes, and its
map side folds a group of copies to one row a task before anything is shuffled. Each row then takes its class
from its md5; where one md5 holds several texts (a collision), from (md5, sha256).

The join back is split: groups with over 1/HOT_SHARE of all rows (at most HOT_SHARE of them, so their table is
broadcast) never enter the shuffle that the others take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

HOT_SHARE = 1024


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null, empty and absent texts are one group. Ties: the smallest id of a group
    stays; repeated rows with that id all count as kept; null ids never stay beside others (a group of only
    null ids has keep_id null and keeps its rows). An empty table gives an empty result. Other columns of
    ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t"))
    digest = stage(
        rows.select("_id", F.unhex(F.md5("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_s")), "exact-digest"
    )
    sizes = digest.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_keep"))
    groups = stage(sizes.filter("_n > 1"), "exact-groups")
    # The bytes decide: rows of one class have the same md5 and the same text.
    classes = stage(
        rows.withColumn("_h", F.unhex(F.md5("_t")))
        .join(groups.select("_h"), "_h", "left_semi")
        .groupBy("_h", "_t")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_keep"))
        .select("_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "_n", "_keep"),
        "exact-classes",
    )
    total = digest.count()
    hot = F.col("_n") > F.lit(max(1, total // HOT_SHARE))
    few, many = classes.filter(hot), classes.filter(~hot)
    tagged = digest.join(
        F.broadcast(few.select("_h", "_s", F.col("_n").alias("_hn"), F.col("_keep").alias("_hk"), F.lit(True).alias("_hot"))),
        ["_h", "_s"], "left",
    )
    # Rows of hot classes carry a null key here, so the shuffle spreads them by their id.
    cold = many.select(F.col("_h").alias("_ch"), F.col("_s").alias("_cs"), F.col("_n").alias("_cn"), F.col("_keep").alias("_ck"))
    hot_rows = tagged.filter("_hot").select("_id", "_s", F.col("_hn").alias("_n"), F.col("_hk").alias("_keep"))
    cold_rows = (
        tagged.filter("_hot IS NULL")
        .join(cold, (F.col("_h") == F.col("_ch")) & (F.col("_s") == F.col("_cs")), "left")
        .select("_id", "_s", F.coalesce("_cn", F.lit(1)).alias("_n"), F.when(F.col("_cn").isNull(), F.col("_id")).otherwise(F.col("_ck")).alias("_keep"))
    )
    return hot_rows.unionByName(cold_rows).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row goes if an equal text has a smaller id, or an id where its own is null; rows of one id and other texts are
    not touched, and repeated rows of the id that stays all stay.
    """
    gone = exact_classes(docs, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("_gone"), F.unhex("text_sha256").alias("_sha")).distinct()
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.unhex(F.sha2(normalised(docs[text_col]), 256)) == gone["_sha"])
    return docs.join(gone, same, "left_anti")

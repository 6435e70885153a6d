"""Write-back: ordered concatenation and span patches, both as Catalyst aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_concat(rows: DataFrame, key: str, order: str, value: Column, sep: str = "") -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p.v), sep).alias("output"))


def json_literal(value: Column, escape_slashes: bool = True) -> Column:
    """A JSON string literal; non-ASCII characters stay, slashes are escaped unless told otherwise."""
    quoted = F.to_json(F.array(value))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.replace(quoted, F.lit("/"), F.lit("\\/")) if escape_slashes else quoted


def patch_spans(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", source_col: str = "source_text") -> DataFrame:
    """Replaces span_start..span_end (code points) of each document by ``replacement``, last span first.

    Only edits that differ from ``original`` count; documents without edits come back unchanged. Spans of one
    document that overlap raise an error.
    """
    changed = edits.filter(~F.col("replacement").eqNullSafe(F.col("original"))).select(
        F.col("doc_id").alias("_doc"), F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), F.col("replacement").alias("r")).alias("edit")
    )
    grouped = changed.groupBy("_doc").agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    apart = F.forall(F.sequence(F.lit(1), F.greatest(F.size("edits") - 1, F.lit(1))), lambda i: (i >= F.size("edits")) | (F.get("edits", i).s >= F.get("edits", i - 1).e))
    grouped = grouped.withColumn("edits", F.when(apart, F.col("edits")).otherwise(F.raise_error(F.lit("overlapping spans"))))
    # Each edit gives the text since the one before it and its own; the text is cut once, whatever the edits' number.
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("edits", i - 1).e)
    pieces = F.transform("edits", lambda e, i: F.concat(F.substring(F.col(source_col), since(i) + 1, e.s - since(i)), e.r))
    last = F.get("edits", F.size("edits") - 1).e
    patched = F.concat(F.array_join(pieces, ""), F.substring(F.col(source_col), last + 1, F.length(source_col)))
    joined = docs.join(grouped, docs[id_col].cast("string") == grouped["_doc"], "left")
    return joined.select(docs[id_col].alias("doc_id"), F.when(F.col("edits").isNull(), F.col(source_col)).otherwise(patched).alias("output"))

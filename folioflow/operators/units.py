"""Unit-level operators over the event table: Catalyst expressions, but for codes that reach over several runs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PART, code


def units(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'TEXT_UNIT'")


def text_of(parts: str = "parts", codes: bool = False) -> Column:
    """Text of a unit: its text parts in order, with the data of codes and markup if asked."""
    if not codes:
        return F.array_join(F.transform(F.filter(parts, lambda p: p.ptype == "text"), lambda p: p.text), "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, p.data, F.lit(""))), "")


def code_kinds(parts: str = "parts") -> Column:
    return F.transform(F.filter(parts, lambda p: p.ptype == "code"), lambda p: p.kind)


def units_processed(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(F.count_if(F.col("event_type") == "TEXT_UNIT").alias("units_processed"), F.count(F.lit(1)).alias("events"))


def find_codes(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match of one inline-code rule in the common regex subset, in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_col), F.posexplode(found).alias("code_index", "code"))


def balanced(events: DataFrame) -> DataFrame:
    """Documents whose START_ and END_ events close in order: running depth never negative and 0 at the end."""
    from pyspark.sql.window import Window

    step = F.when(F.col("event_type").startswith("START_"), 1).when(F.col("event_type").startswith("END_"), -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("doc_id").orderBy("seq"))
    return events.withColumn("depth", depth).groupBy("doc_id").agg(((F.min("depth") >= 0) & (F.max_by("depth", "seq") == 0)).alias("balanced"))


def split_across(parts: list[dict], rules: list[re.Pattern]) -> list[dict]:
    """Parts with codes for what the rules find in the text parts taken together.

    A match may reach over several runs: its code stands where it begins, the other runs lose their share. Of matches
    that overlap, the first counts, the shorter if they begin together; empty matches do not count.
    """
    whole = "".join(p["text"] or "" for p in parts if p["ptype"] == "text")
    found, cursor = [], 0
    for start, end in sorted(m.span() for rule in rules for m in rule.finditer(whole)):
        if start >= cursor and end > start:
            found.append((start, end))
            cursor = end
    out, at, k = [], 0, 0
    for p in parts:
        if p["ptype"] != "text" or not p["text"]:
            out.append(p)
            continue
        stop = at + len(p["text"])
        while at < stop:
            while k < len(found) and found[k][1] <= at:
                k += 1
            start, end = found[k] if k < len(found) else (stop, stop)
            if start > at:  # plain text up to the next match or the end of the run
                out.append(p | {"text": whole[at : min(start, stop)]})
            elif start == at:
                out.append(code(whole[start:end], "regxph"))
            at = min(start, stop) if start > at else min(end, stop)
    return out


def codes_across(parts: str | Column, rules: list[str]) -> Column:
    """``split_across`` of a parts column by rules in Python's pattern language."""

    @F.pandas_udf(f"array<{PART}>")
    def run(column: pd.Series) -> pd.Series:
        compiled = [re.compile(r) for r in rules]
        return pd.Series([None if found is None else split_across(list(found), compiled) for found in column], dtype=object)

    return run(parts)

"""Complex fields of word-processing documents: begin, separate and end codes over the units of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "doc_id string, field_id int, parent_id int, depth int, instruction string, result string, error string"


def fields_of(marks: list[tuple[str, str]]) -> list[dict]:
    """Adjacency rows from (kind, data) in order; field ids count begins, depth counts from 1."""
    out, stack = [], []
    for kind, data in marks:
        if kind == "field_char" and data == "begin":
            out.append({"field_id": len(out), "parent_id": stack[-1]["field_id"] if stack else None, "depth": len(stack) + 1, "instruction": "", "result": "", "separated": False})
            stack.append(out[-1])
        elif kind == "field_char" and data == "separate":
            if not stack:
                raise ValueError("separate outside a field")
            stack[-1]["separated"] = True
        elif kind == "field_char" and data == "end":
            if not stack:
                raise ValueError("end outside a field")
            closed = stack.pop()
            if stack and stack[-1]["separated"]:
                stack[-1]["result"] += closed["result"]
        elif stack and kind == "field_instruction" and not stack[-1]["separated"]:
            stack[-1]["instruction"] += data
        elif stack and kind == "text" and stack[-1]["separated"]:
            stack[-1]["result"] += data
    if stack:
        raise ValueError("field without end")
    return [{k: v.strip() if k == "instruction" else v for k, v in f.items() if k != "separated"} for f in out]


def complex_fields(events: DataFrame) -> DataFrame:
    """One row per field of each document; an unbalanced document gives one row with the error.

    State is per document, so a document's fields never mix with another's. Only documents that hold field
    characters are shuffled.
    """
    mark = lambda p: F.struct(F.when(p.ptype == "text", "text").otherwise(p.kind).alias("kind"), F.coalesce(p.text, p.data).alias("data"))
    rows = events.filter("event_type = 'TEXT_UNIT'").select("doc_id", "seq", F.transform("parts", mark).alias("marks"))
    held = rows.filter(F.exists("marks", lambda m: m.kind == "field_char")).select("doc_id").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc_id = pdf["doc_id"].iloc[0]
        marks = [(m["kind"], m["data"]) for found in pdf.sort_values("seq")["marks"] for m in found]
        try:
            found = [f | {"doc_id": doc_id, "error": None} for f in fields_of(marks)]
        except ValueError as e:
            found = [{"doc_id": doc_id, "error": str(e)}]
        out = pd.DataFrame(found, columns=["doc_id", "field_id", "parent_id", "depth", "instruction", "result", "error"])
        return out.astype({"field_id": "Int64", "parent_id": "Int64", "depth": "Int64"})

    return rows.join(held, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(run, FIELDS)

"""XML trees as ordered rows of opening and closing components, and back to tags."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsers import local

# Prefixes of the name spaces that are told apart, and the parts that elements play.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
ROLES = {
    "run_properties": ("rPr", "defRPr", "endParaRPr"),
    "block_properties": ("pPr", "tblPr", "tcPr", "trPr", "sectPr"),
    "formula": ("oMath", "oMathPara"),
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names}
TREE = (
    "doc_id string, seq int, component_id string, kind string, name string, attributes array<struct<k:string,v:string>>, "
    "parent_id string, matches string, role string, styled boolean, error string"
)


def prefixed(name: str) -> str:
    space, _, own = name.rpartition("}")
    found = PREFIXES.get(space.lstrip("{"))
    return f"{found}:{own}" if found else own


def components(root: ET.Element) -> Iterator[dict]:
    """A row where each element opens and one where it closes, in order; no recursion, so depth is not bounded."""
    path: list[tuple[Iterator[ET.Element], dict]] = []
    count, coming = 0, iter([root])
    while True:
        el = next(coming, None)
        count += 1
        if el is None:
            if not path:
                return
            coming, opened = path.pop()
            yield opened | {"component_id": f"mc-{count}", "kind": "end", "attributes": [], "matches": opened["component_id"]}
            continue
        role = ROLE_OF.get(local(el.tag), "generic")
        styled = role == "block_properties" and any(prefixed(c.tag) == "w:pStyle" for c in el)
        row = {
            "component_id": f"mc-{count}", "kind": "start", "name": prefixed(el.tag), "attributes": [{"k": k, "v": v} for k, v in sorted((prefixed(k), v) for k, v in el.attrib.items())],
            "parent_id": path[-1][1]["component_id"] if path else None, "matches": None, "role": role, "styled": styled,
        }
        yield row
        path.append((coming, row))
        coming = iter(el)


def markup_tree(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source_text") -> DataFrame:
    """Components of each XML text, key (doc_id, seq). A text that is no XML is one row with its error; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pa.string()
        attributes = pa.list_(pa.struct([("k", s), ("v", s)]))
        names = [("doc_id", s), ("seq", pa.int32()), ("component_id", s), ("kind", s), ("name", s), ("attributes", attributes), ("parent_id", s), ("matches", s), ("role", s), ("styled", pa.bool_()), ("error", s)]
        for batch in batches:
            for doc_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not source:
                    continue
                try:
                    rows = [r | {"doc_id": doc_id, "seq": n} for n, r in enumerate(components(ET.fromstring(source)))]
                except ET.ParseError as e:
                    rows = [{"doc_id": doc_id, "seq": 0, "error": f"ParseError: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(names))

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source")).mapInArrow(run, TREE)


def tag_of() -> Column:
    """The tag of a component: the flat skeleton of a document is its tags in order."""
    quoted = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    own = F.array_join(F.transform("attributes", lambda a: F.concat(F.lit(" "), a.k, F.lit('="'), quoted(a.v), F.lit('"'))), "")
    return F.when(F.col("kind") == "start", F.concat(F.lit("<"), F.col("name"), own, F.lit(">"))).otherwise(F.concat(F.lit("</"), F.col("name"), F.lit(">")))

"""Documents to events: parsers run over Arrow batches, one failed document is one error row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import END, EVENTS, START
from .parsers import BINARY, PARSERS

BATCH_EVENTS = 4096


def arrow_schema() -> pa.Schema:
    s, n = pa.string(), pa.int32()
    attributes = pa.list_(pa.struct([("k", s), ("v", s)]))
    parts = pa.list_(pa.struct([*((c, s) for c in ("ptype", "text", "kind", "name", "data", "target")), ("attributes", attributes)]))
    return pa.schema(
        [("doc_id", s), ("seq", n), ("event_type", s), ("unit_id", s), ("content", s), ("parts", parts), ("target_parts", parts),
         ("metadata", pa.map_(s, s)), ("span_start", n), ("span_end", n), ("status", s), ("error_code", s), ("error_message", s)]
    )


def parse(docs: DataFrame, fmt: str, id_col: str = "doc_id", source_col: str = "source_text", envelope: bool = False, **options) -> DataFrame:
    """The events of each document; key (doc_id, seq). Null sources count as empty.

    ``envelope`` adds START_DOCUMENT and END_DOCUMENT. A document that cannot be parsed gives one row with
    status FAILED and the error, and no other; nothing is shuffled.
    """
    read = PARSERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        for batch in batches:
            rows = []
            for doc_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(read(source, **options)) if source else []
                    if envelope:
                        found = [{"event_type": START}, *found, {"event_type": END}]
                    for n, e in enumerate(found):
                        meta = e.get("metadata")
                        rows.append(e | {"doc_id": doc_id, "seq": n, "status": "COMPLETED", "metadata": None if meta is None else list(meta.items())})
                except Exception as e:  # one bad document is a row, not the end of the job
                    rows.append({"doc_id": doc_id, "seq": 0, "event_type": "ERROR", "status": "FAILED", "error_code": "EXECUTION_FAILED", "error_message": f"{type(e).__name__}: {e}"})
                if len(rows) >= BATCH_EVENTS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    empty = F.lit(b"") if fmt in BINARY else F.lit("")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(source_col), empty).alias("source"))
    return rows.mapInArrow(run, EVENTS)

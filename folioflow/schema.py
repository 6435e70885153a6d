"""Canonical event table: one row per event, ordered by (doc_id, seq)."""

from __future__ import annotations

PART = "struct<ptype:string,text:string,kind:string,name:string,data:string,target:string,attributes:array<struct<k:string,v:string>>>"
EVENTS = (
    "doc_id string, seq int, event_type string, unit_id string, content string, "
    f"parts array<{PART}>, target_parts array<{PART}>, metadata map<string,string>, "
    "span_start int, span_end int, status string, error_code string, error_message string"
)

START, END, UNIT, DOCUMENT_PART = "START_DOCUMENT", "END_DOCUMENT", "TEXT_UNIT", "DOCUMENT_PART"


def part(ptype: str, text: str | None = None, **more) -> dict:
    return {"ptype": ptype, "text": text, "kind": None, "name": None, "data": None, "target": None, "attributes": []} | more


def text(value: str) -> dict:
    return part("text", value)


def code(data: str, kind: str, target: str | None = None) -> dict:
    return part("code", None, data=data, kind=kind, target=target)


def markup(kind: str, name: str, attributes=(), data: str | None = None) -> dict:
    return part("markup", None, kind=kind, name=name, data=data, attributes=[{"k": k, "v": v} for k, v in attributes])


def event(event_type: str, unit_id: str | None = None, parts=None, content=None, metadata=None, span=(None, None), target=None) -> dict:
    return {"event_type": event_type, "unit_id": unit_id, "content": content, "parts": parts, "target_parts": target, "metadata": metadata, "span_start": span[0], "span_end": span[1]}


def unit(unit_id: str, parts: list[dict], metadata: dict[str, str] | None = None, span=(None, None), target=None) -> dict:
    return event(UNIT, unit_id, parts, None, metadata or {}, span, target)

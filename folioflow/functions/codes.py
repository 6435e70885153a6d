"""Encoders and decoders shared by the write-back operators, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(value: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(safe))
    return value


def xml_of(parts: str) -> Column:
    """Mixed content of a unit: escaped text, tags with escaped attributes, codes as they are."""

    def one(p: Column) -> Column:
        attributes = F.array_join(F.transform(p.attributes, lambda a: F.concat(F.lit(" "), a.k, F.lit('="'), xml_escape(a.v), F.lit('"'))), "")
        tag = F.when(p.kind == "start", F.concat(F.lit("<"), p["name"], attributes, F.lit(">"))).when(p.kind == "end", F.concat(F.lit("</"), p["name"], F.lit(">"))).otherwise(F.concat(F.lit("<"), p["name"], attributes, F.lit("/>")))
        return F.when(p.ptype == "text", xml_escape(p.text)).when(p.ptype == "markup", tag).otherwise(p.data)

    return F.array_join(F.transform(parts, one), "")


def snake_case(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def local_name(value: Column) -> Column:
    """{uri}name as name."""
    return F.regexp_replace(value, r"^\{[^}]*\}", "")


def is_on(value: Column) -> Column:
    """A toggle property: present and not switched off."""
    return F.coalesce(~F.lower(value).isin("0", "false", "off", "no"), F.lit(True))


def overlaid(*maps: Column) -> Column:
    """Property maps in order, later ones win; null maps count as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        out = F.map_zip_with(out, F.coalesce(m, empty), lambda k, a, b: F.coalesce(b, a))
    return out

"""Registered queries of the document operators and their SQL counterparts, over whole tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import catalog, patch
from ..operators import units as ops
from ..sources.reader import parse

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.withColumn("doc_id", F.concat_ws("-", "conv_id", "turn"))


def spread(df: DataFrame) -> DataFrame:
    """Documents over all cores before a parser, if their files give fewer splits than there are cores; else as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


# Plain text: no parser needed, the unit is the text.
@query("SELECT doc_id, 'txt-1' AS unit_id, text AS unit_text FROM documents WHERE text <> ''")
def txt_units(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.lit("txt-1").alias("unit_id"), F.col("text").alias("unit_text"))


def txt_events(spark, sf_dir):
    row = lambda seq, kind, content: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event_type"), content.cast("string").alias("content"))
    rows = F.array(row(0, "START_DOCUMENT", F.lit(None)), row(1, "TEXT_UNIT", F.col("text")), row(2, "END_DOCUMENT", F.lit(None)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*").filter("event_type <> 'TEXT_UNIT' OR content <> ''")


@query(
    """SELECT doc_id, 0 AS seq, 'START_DOCUMENT' AS event_type, NULL AS content FROM documents
    UNION ALL SELECT doc_id, 1, 'TEXT_UNIT', text FROM documents WHERE text <> ''
    UNION ALL SELECT doc_id, 2, 'END_DOCUMENT', NULL FROM documents"""
)
def txt_event_stream(spark, sf_dir):
    return txt_events(spark, sf_dir)


@query("SELECT doc_id, count(*) FILTER (text <> '') AS units_processed, 2 + count(*) FILTER (text <> '') AS events FROM documents GROUP BY doc_id")
def txt_units_processed(spark, sf_dir):
    return ops.units_processed(txt_events(spark, sf_dir))


@query("SELECT doc_id, text AS output FROM documents")
def txt_round_trip(spark, sf_dir):
    return patch.ordered_concat(txt_events(spark, sf_dir).filter("event_type = 'TEXT_UNIT'"), "doc_id", "seq", F.col("content"), "\n")


@query("SELECT doc_id, (u.i - 1)::INT AS line_no, u.line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents)")
def line_units(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


# JSON.
def json_docs(spark, sf_dir, extra: list[Column] = ()):
    t = turns(spark, sf_dir)
    return spread(t.select("doc_id", F.to_json(F.struct(*extra, "role", "text")).alias("source_text")))


def json_rows(events: DataFrame) -> DataFrame:
    return ops.units(events).select("doc_id", F.col("metadata")["json_path"].alias("path"), F.col("metadata")["name"].alias("name"), ops.text_of().alias("unit_text"))


@query(
    """SELECT conv_id || '-' || turn AS doc_id, '/role' AS path, 'role' AS name, role AS unit_text FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, '/text', 'text', text FROM conversations"""
)
def json_units(spark, sf_dir):
    return json_rows(parse(json_docs(spark, sf_dir), "json"))


@query("SELECT conv_id || '-' || turn AS doc_id, '/text' AS path, 'text' AS name, text AS unit_text FROM conversations")
def json_rules_extract(spark, sf_dir):
    return json_rows(parse(json_docs(spark, sf_dir), "json", extractAllPairs=False, extractionRules="te.t"))


@query("SELECT conv_id || '-' || turn AS doc_id, '/text' AS path, 'text' AS name, text AS unit_text FROM conversations")
def json_exceptions(spark, sf_dir):
    return json_rows(parse(json_docs(spark, sf_dir), "json", exceptions="^ro"))


@query("SELECT conv_id || '-' || turn AS doc_id, '/text' AS path, role AS name, text AS unit_text FROM conversations")
def json_id_names(spark, sf_dir):
    return json_rows(parse(json_docs(spark, sf_dir), "json", idRules="role", useIdStack=True))


@query("""SELECT conv_id || '-' || turn AS doc_id, text AS unit_text, '[{"from": "role", "text": "' || role || '"}]' AS notes FROM conversations""")
def json_notes(spark, sf_dir):
    found = ops.units(parse(json_docs(spark, sf_dir), "json", noteRules="role"))
    return found.select("doc_id", ops.text_of().alias("unit_text"), F.col("metadata")["notes"].alias("notes"))


@query("SELECT 0::BIGINT AS n_units, count(*) AS n_documents FROM events")
def json_props_no_strings(spark, sf_dir):
    docs = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("source_text"))
    found = parse(docs, "json", id_col="event_id", envelope=True)
    return found.agg(F.count_if(F.col("event_type") == "TEXT_UNIT").alias("n_units"), F.count_if(F.col("event_type") == "END_DOCUMENT").alias("n_documents"))


@query(
    r"""SELECT conv_id || '-' || turn AS doc_id,
    '{"role":"' || role || '","text":"[' || replace(replace(text, chr(10), '\n'), '/', '\/') || ']"}' AS output FROM conversations"""
)
def json_patch(spark, sf_dir):
    docs = json_docs(spark, sf_dir)
    found = ops.units(parse(docs, "json")).withColumn("t", ops.text_of())
    new = F.when(F.col("metadata")["json_path"] == "/text", F.concat(F.lit("["), "t", F.lit("]"))).otherwise(F.col("t"))
    edits = found.select("doc_id", "span_start", "span_end", patch.json_literal(F.col("t")).alias("original"), patch.json_literal(new).alias("replacement"))
    return patch.patch_spans(docs, edits)


# YAML.
@query(
    """SELECT n_nationkey AS doc_id, 'nation/name' AS path, n_name AS unit_text FROM nation
    UNION ALL SELECT n_nationkey, 'nation/keys/0', n_nationkey::VARCHAR FROM nation
    UNION ALL SELECT n_nationkey, 'nation/keys/1', n_regionkey::VARCHAR FROM nation"""
)
def yaml_units(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    docs = n.select("n_nationkey", F.concat(F.lit("# one\nnation:\n  name: "), F.to_json(F.array("n_name")).substr(F.lit(2), F.length(F.to_json(F.array("n_name"))) - 2), F.lit("\n  none: null\n  keys:\n  - "), "n_nationkey", F.lit("\n  - "), "n_regionkey", F.lit("\n")).alias("source_text"))
    found = ops.units(parse(docs, "yaml", id_col="n_nationkey"))
    return found.select(F.col("doc_id").cast("int").alias("doc_id"), F.col("metadata")["yaml_path"].alias("path"), ops.text_of().alias("unit_text"))


# XLIFF.
def escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xliff_docs(spark, sf_dir):
    t = turns(spark, sf_dir)
    head, mid = '<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body><trans-unit id="', '"><source>'
    body = F.concat(F.lit(head), "turn", F.lit(mid), escaped("text"), F.lit('<ph id="1"/></source><target>'), escaped("role"), F.lit("</target></trans-unit></body></file></xliff>"))
    return spread(t.select("doc_id", body.alias("source_text")))


@query("SELECT conv_id || '-' || turn AS doc_id, turn::VARCHAR AS unit_id, text AS unit_text, 1::BIGINT AS empty_tags FROM conversations")
def xliff_units(spark, sf_dir):
    found = ops.units(parse(xliff_docs(spark, sf_dir), "xliff"))
    return found.select("doc_id", "unit_id", ops.text_of().alias("unit_text"), F.size(F.filter("parts", lambda p: p.kind == "empty")).cast("long").alias("empty_tags"))


@query("SELECT conv_id || '-' || turn AS doc_id, role AS target_text FROM conversations")
def xliff_targets(spark, sf_dir):
    return ops.units(parse(xliff_docs(spark, sf_dir), "xliff")).select("doc_id", ops.text_of("target_parts").alias("target_text"))


@query(
    """SELECT conv_id || '-' || turn AS doc_id, 'u' || turn || ':s1' AS unit_id, text AS unit_text FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, 'u' || turn || ':1', role FROM conversations"""
)
def xliff2_segments(spark, sf_dir):
    t = turns(spark, sf_dir)
    body = F.concat(F.lit('<xliff version="2.0" xmlns="urn:oasis:names:tc:xliff:document:2.0"><file id="f"><unit id="u'), "turn", F.lit('"><segment id="s1"><source>'), escaped("text"), F.lit("</source></segment><segment><source>"), escaped("role"), F.lit("</source></segment></unit></file></xliff>"))
    return ops.units(parse(spread(t.select("doc_id", body.alias("source_text"))), "xliff2")).select("doc_id", "unit_id", ops.text_of().alias("unit_text"))


# HTML.
def html_events(spark, sf_dir):
    return parse(spread(read(spark, sf_dir, "pages")), "html", "page_id", "html")


@query("SELECT conv_id || '-' || turn AS doc_id, 3::BIGINT AS units, 2::BIGINT AS inline_tags, (2 * length(text) + length(role) + 4)::BIGINT AS characters FROM conversations")
def html_units_per_page(spark, sf_dir):
    t = turns(spark, sf_dir)
    body = F.concat(F.lit("<html><body><h1>"), "role", F.lit("</h1><p>"), escaped("text"), F.lit("<b>bold</b></p><!-- c --><script>x()</script><div><ul><li><i>"), escaped("text"), F.lit("</i></li></ul></div><p> </p></body></html>"))
    found = ops.units(parse(spread(t.select("doc_id", body.alias("html"))), "html", source_col="html"))
    inline = F.size(F.filter("parts", lambda p: (p.ptype == "markup") & (p.kind == "start") & p["name"].isin("b", "i")))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(inline).cast("long").alias("inline_tags"), F.sum(F.length(ops.text_of())).alias("characters"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def html_titles(spark, sf_dir):
    found = ops.units(html_events(spark, sf_dir)).filter(F.col("metadata")["html_element"] == "title")
    return found.select(F.col("doc_id").cast("long").alias("page_id"), ops.text_of().alias("title"))


@query("SELECT page_id AS doc_id, html AS output FROM pages")
def html_patch_roundtrip(spark, sf_dir):
    """Every unit is written back from its parts over its span; the page comes out as it went in."""
    pages = read(spark, sf_dir, "pages")
    found = ops.units(html_events(spark, sf_dir))
    edits = found.select("doc_id", "span_start", "span_end", F.lit(None).cast("string").alias("original"), ops.text_of(codes=True).alias("replacement"))
    return patch.patch_spans(pages, edits, "page_id", "html")


# Markdown, EPUB, DOCX.
@query("SELECT doc_id, text AS output FROM documents WHERE text <> ''")
def md_round_trip(spark, sf_dir):
    found = parse(read(spark, sf_dir, "documents"), "markdown", source_col="text")
    out = patch.ordered_concat(found, "doc_id", "seq", F.coalesce("content", ops.text_of(codes=True)))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "output")


MD_SQL = r"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents WHERE text <> ''),
    b AS (SELECT doc_id, u.i AS i, u.line AS line, regexp_extract(u.line, '^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s?)?') AS lead FROM l),
    k AS (SELECT doc_id, i, substr(line, length(lead) + 1) AS body FROM b WHERE trim(substr(line, length(lead) + 1)) <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::VARCHAR AS unit_id, body AS unit_text,
    len(regexp_extract_all(body, '\*\*[^*\n]+\*\*|\*[^*\n]+\*|`[^`\n]+`|!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)'))::INT AS codes FROM k"""


@query(MD_SQL)
def md_units(spark, sf_dir):
    found = ops.units(parse(spread(read(spark, sf_dir, "documents")), "markdown", source_col="text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "unit_id", ops.text_of(codes=True).alias("unit_text"), F.size(ops.code_kinds()).alias("codes"))


@F.pandas_udf(BinaryType())
def zipped(chapter: pd.Series) -> pd.Series:
    def one(page: str) -> bytes:
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("OEBPS/chapter.xhtml", page)
            z.writestr("OEBPS/image.png", b"")
        return held.getvalue()

    return chapter.map(one)


@query(r"SELECT page_id, 'OEBPS/chapter.xhtml' AS epub_path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def epub_units(spark, sf_dir):
    books = spread(read(spark, sf_dir, "pages")).select("page_id", zipped("html").alias("source_bytes"))
    found = ops.units(parse(books, "epub", "page_id", "source_bytes")).filter(F.col("metadata")["html_element"] == "title")
    return found.select(F.col("doc_id").cast("long").alias("page_id"), F.col("metadata")["epub_path"].alias("epub_path"), ops.text_of().alias("title"))


@F.pandas_udf(BinaryType())
def word_file(role: pd.Series, body: pd.Series) -> pd.Series:
    from xml.sax.saxutils import escape

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def one(a: str, b: str) -> bytes:
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            z.writestr("word/document.xml", f'<w:document {space}><w:body><w:p><w:pPr><w:pStyle w:val="Role"/></w:pPr><w:r><w:t>{escape(a)}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>{escape(b)}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
            z.writestr("word/footnotes.xml", f'<w:footnotes {space}><w:footnote w:id="0"><w:p><w:r><w:t>rule</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>')
        return held.getvalue()

    return pd.Series([one(a, b) for a, b in zip(role, body, strict=True)])


@query(
    """SELECT conv_id || '-' || turn AS doc_id, 'body' AS part, '0' AS paragraph, role AS unit_text FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, 'body', '1', text FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, 'footnote', '1', 'note' FROM conversations"""
)
def docx_units(spark, sf_dir):
    files = spread(turns(spark, sf_dir)).select("doc_id", word_file("role", "text").alias("source_bytes"))
    found = ops.units(parse(files, "docx", source_col="source_bytes"))
    m = F.col("metadata")
    return found.select("doc_id", m["part"].alias("part"), m["source_paragraph_index"].alias("paragraph"), ops.text_of().alias("unit_text"))


# Code finder, resolver, comparison, jobs, styles, coverage.
@query("SELECT doc_id, (u.i - 1)::INT AS code_index, u.code FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Z][a-z]+tion'), lambda x, i: {'code': x, 'i': i})) AS u FROM documents)")
def code_finder_documents(spark, sf_dir):
    return ops.find_codes(read(spark, sf_dir, "documents"), "[A-Z][a-z]+tion")


@query(
    """SELECT conv_id || '-' || turn AS doc_id, CASE turn % 4 WHEN 0 THEN 'native.xliff' WHEN 1 THEN 'native.json'
    WHEN 2 THEN 'native.html' END AS resolved_filter FROM conversations"""
)
def resolver_best(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("xlf", "bin", "HTM", "none"))), (F.col("turn") % 4 + 1).cast("int"))
    asked = turns(spark, sf_dir).select("doc_id", F.concat(F.lit("a."), ext).alias("path"), F.when(F.col("turn") % 4 == 1, "json").alias("format"), F.lit(None).cast("string").alias("filter_id"), F.lit("").alias("head"))
    return catalog.resolve(asked)


@query("SELECT conv_id || '-' || turn AS doc_id, CASE WHEN turn % 2 = 0 THEN 'native.xliff2' ELSE 'native.xliff' END AS resolved_filter FROM conversations")
def resolver_sniff(spark, sf_dir):
    head = F.concat(F.lit('<?xml version="1.0"?><xliff xmlns="urn:oasis:names:tc:xliff:document:'), F.when(F.col("turn") % 2 == 0, "2.0").otherwise("1.2"), F.lit('">'))
    asked = turns(spark, sf_dir).select("doc_id", F.lit("a.xlf").alias("path"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("filter_id"), head.alias("head"))
    return catalog.resolve(asked)


@query(
    """WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 5 <> 4),
    r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn % 7 <> 6)
    SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, l.text AS left_value, r.text AS right_value
    FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn WHERE l.text IS DISTINCT FROM r.text"""
)
def diff_streams(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    right = c.filter("turn % 7 <> 6").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return catalog.compare_streams(c.filter("turn % 5 <> 4"), right, ["conv_id", "turn"], "text")


@query("SELECT n_nationkey::VARCHAR AS style_id, (n_nationkey % 5)::VARCHAR AS root_id, (n_nationkey // 5)::INT AS depth FROM nation")
def style_resolve(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    parent = F.when(F.col("n_nationkey") >= 5, (F.col("n_nationkey") - 5).cast("string"))
    return catalog.resolve_chain(n.select(F.col("n_nationkey").cast("string").alias("style_id"), F.lit("paragraph").alias("type"), parent.alias("based_on")))


@query(
    """WITH f AS (SELECT p_partkey::VARCHAR AS filter_id, list_distinct(string_split(p_type, ' ')) AS features FROM part)
    SELECT filter_id, len(list_intersect(features, ['STANDARD', 'SMALL', 'BRASS', 'TIN']))::INT AS supported, len(features)::INT AS total,
    len(list_intersect(features, ['STANDARD', 'SMALL', 'BRASS', 'TIN'])) / len(features)::DOUBLE AS ratio,
    array_to_string(list_sort(list_filter(features, lambda x: NOT list_contains(['STANDARD', 'SMALL', 'BRASS', 'TIN'], x))), ',') AS gap FROM f"""
)
def ir_coverage(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return catalog.coverage(p.select(F.col("p_partkey").cast("string").alias("filter_id"), F.array_distinct(F.split("p_type", " ")).alias("features")), ["STANDARD", "SMALL", "BRASS", "TIN"])


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS version, event_type AS type, event_id::VARCHAR AS id, props AS payload, event_id % 3 <> 0 AS is_valid FROM events")
def ipc_decode(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("version"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("payload")))
    return catalog.decode_ipc(e.select(line.alias("value")))


from . import analysis, building, writing  # noqa: E402, F401  - they register their queries here

"""Queries of write-back and of word-processing packages that are put together from the driver tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..operators import catalog, fields, patch, writers
from ..operators import units as ops
from ..sources import packages
from ..sources.reader import parse
from .queries import escaped, query, read, spread, turns, xliff_docs, zipped


@F.pandas_udf(BinaryType())
def package(names: pd.Series, bodies: pd.Series) -> pd.Series:
    """A ZIP of members and their texts."""

    def one(members, texts) -> bytes:
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            for name, body in zip(members, texts, strict=True):
                z.writestr(name, body)
        return held.getvalue()

    return pd.Series([one(a, b) for a, b in zip(names, bodies, strict=True)])


# Name spaces of the packages built here.
SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"


def texts(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def words(spark, sf_dir, body: Column, parts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source_bytes, key columns: a package for each turn with this body and these other parts."""
    members = {"word/document.xml": texts(f"<w:document {SPACE}><w:body>", body, "</w:body></w:document>")} | {k: F.lit(v) for k, v in (parts or {}).items()}
    t = spread(turns(spark, sf_dir))
    return t.select("doc_id", "role", "text", package(F.array(*map(F.lit, members)), F.array(*members.values())).alias("source_bytes"))


def docx(files: DataFrame, **options) -> DataFrame:
    return ops.units(parse(files, "docx", source_col="source_bytes", **options))


def paragraph(text: str | Column, look: str = "", style: str = "") -> Column:
    head = f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "<w:p>"
    return texts(f"{head}<w:r><w:rPr>{look}</w:rPr><w:t>", text, "</w:t></w:r></w:p>")


@query("SELECT conv_id || '-' || turn AS doc_id, role AS run, 'bold=true,color=FF0000,font=Sans,font_ascii=Sans,font_cs=Serif,italic=false,underline=single' AS look FROM conversations")
def docx_run_looks(spark, sf_dir):
    body = paragraph(escaped("role"), '<w:b/><w:i w:val="off"/><w:u/><w:color w:val="FF0000"/><w:rFonts w:ascii="Sans" w:cs="Serif"/>')
    found = docx(words(spark, sf_dir, body)).select("doc_id", F.explode("parts").alias("p"))
    return found.select("doc_id", F.col("p.text").alias("run"), F.array_join(F.array_sort(F.transform("p.attributes", lambda a: F.concat(a.k, F.lit("="), a.v))), ",").alias("look"))


STYLES = f'<w:styles {SPACE}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="Base" w:default="1"><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Red"><w:basedOn w:val="Base"/><w:rPr><w:color w:val="red"/></w:rPr></w:style><w:style w:type="character" w:styleId="Off"><w:link w:val="Red"/><w:rPr><w:vanish/></w:rPr></w:style></w:styles>'


@query("SELECT conv_id || '-' || turn AS doc_id, text AS unit_text, 'excluded_style' AS kinds FROM conversations")
def docx_exclusions(spark, sf_dir):
    """Left out: a listed paragraph style, a colour that comes by inheritance (as a code), hidden text by a character style."""
    body = texts(paragraph(escaped("role"), style="Role"), '<w:p><w:pPr><w:pStyle w:val="Red"/></w:pPr><w:r><w:t>red</w:t></w:r><w:r><w:rPr><w:color w:val="#0000FF"/></w:rPr><w:t>', escaped("text"), '</w:t></w:r><w:r><w:rPr><w:rStyle w:val="Off"/></w:rPr><w:t>hidden</w:t></w:r></w:p>')
    found = docx(words(spark, sf_dir, body, {"word/styles.xml": STYLES}), exclude_styles=["Role"], exclude_colors=["red"])
    return found.select("doc_id", ops.text_of().alias("unit_text"), F.array_join(ops.code_kinds(), ",").alias("kinds"))


@query("SELECT conv_id || '-' || turn AS doc_id, role AS unit_text FROM conversations")
def docx_style_include(spark, sf_dir):
    body = texts(paragraph(escaped("role"), style="Role"), paragraph(escaped("text"), style="Other"), paragraph("plain"))
    found = docx(words(spark, sf_dir, body), exclude_styles=["Role"], style_mode="include")
    return found.select("doc_id", ops.text_of().alias("unit_text")).filter("unit_text <> ''")


NUMBERING = f'<w:numbering {SPACE}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:lvlText w:val="Part %1:"/></w:lvl><w:lvl w:ilvl="1"><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="1"><w:lvl w:ilvl="1"><w:lvlText w:val="Own %2"/></w:lvl></w:lvlOverride></w:num></w:numbering>'


def listed(level: int) -> str:
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'


@query("SELECT conv_id || '-' || turn AS doc_id, '1' AS num_level, 'Own ' AS unit_text, 1 AS codes FROM conversations UNION ALL SELECT conv_id || '-' || turn, '0', 'Part :', 1 FROM conversations")
def docx_numbering(spark, sf_dir):
    files = words(spark, sf_dir, texts(listed(1), listed(0), listed(1)), {"word/numbering.xml": NUMBERING})
    found = docx(files, numbering_texts=True).filter(F.col("metadata")["part"] == "numbering")
    return found.select("doc_id", F.col("metadata")["num_level"].alias("num_level"), ops.text_of().alias("unit_text"), F.size(ops.code_kinds()).alias("codes"))


BOX = '<w:drawing><wp:docPr xmlns:wp="urn:wp" id="3" name="Frame"/><wps:txbx xmlns:wps="urn:wps"><w:txbxContent>{0}</w:txbxContent></wps:txbx></w:drawing>'
OLD_BOX = '<w:pict><v:textbox xmlns:v="urn:v"><w:txbxContent>{0}</w:txbxContent></v:textbox></w:pict>'


def boxed(text: Column) -> Column:
    inner = texts("<w:p><w:r><w:t>", text, "</w:t></w:r></w:p>")
    (a, b), (c, d) = BOX.split("{0}"), OLD_BOX.split("{0}")
    return texts("<w:p><w:r><w:t>host</w:t></w:r><w:r>", a, inner, b, c, inner, d, "</w:r></w:p>")


@query(
    """SELECT conv_id || '-' || turn AS doc_id, 'host' AS unit_text, NULL AS text_box, '0' AS paragraph, NULL AS twin, NULL AS locator FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, text, '0', '1', '2', NULL FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'Frame', NULL, '0', NULL, 'docPr' FROM conversations"""
)
def docx_text_boxes(spark, sf_dir):
    """A box that is there as a drawing and in the older form is one unit; names of drawings are units on demand."""
    m = F.col("metadata")
    found = docx(words(spark, sf_dir, boxed(escaped("text"))), attributes=True)
    return found.select("doc_id", ops.text_of().alias("unit_text"), m["text_box"].alias("text_box"), m["source_paragraph_index"].alias("paragraph"), m["paired_paragraph_index"].alias("twin"), F.get_json_object(m["source_attribute_locators"], "$[0].tag").alias("locator"))


RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{0}" Target="https://example.org/a?b=1&amp;c=2" TargetMode="External"/></Relationships>'.format(LINK)
CORE = '<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:title>Old title</dc:title><cp:revision>3</cp:revision></cp:coreProperties>'


def linked(spark, sf_dir) -> DataFrame:
    body = texts('<w:p><w:hyperlink r:id="rId1"><w:r><w:t>', escaped("role"), "</w:t></w:r></w:hyperlink></w:p>", paragraph(escaped("text"), "<w:b/>"))
    return words(spark, sf_dir, body, {"word/_rels/document.xml.rels": RELS, "docProps/core.xml": CORE})


@query(
    """SELECT conv_id || '-' || turn AS doc_id, 'core_properties' AS part, 'Old title' AS unit_text, NULL AS target FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'relationships', 'https://example.org/a?b=1&c=2', NULL FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, 'body', role, 'https://example.org/a?b=1&c=2' FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'body', text, NULL FROM conversations"""
)
def docx_links(spark, sf_dir):
    return docx(linked(spark, sf_dir), external_links=True).select("doc_id", F.col("metadata")["part"].alias("part"), ops.text_of(codes=True).alias("unit_text"), F.get("parts", F.lit(0)).target.alias("target"))


@query(
    """SELECT conv_id || '-' || turn AS doc_id, 'core_properties' AS part, 'New & <title>' AS unit_text FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'relationships', 'https://example.org/"x"' FROM conversations
    UNION ALL SELECT conv_id || '-' || turn, 'body', role FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'body', ' <' || text || '> ' FROM conversations"""
)
def docx_patch(spark, sf_dir):
    """Edits by locator, written into the package and read again."""
    files = linked(spark, sf_dir)
    row = lambda part, place, new: F.struct(F.lit(part).alias("key1"), F.lit(place).alias("key2"), new.alias("replacement"))
    edits = files.select("doc_id", F.explode(F.array(row("docProps/core.xml", "element:title", F.lit("New & <title>")), row("word/_rels/document.xml.rels", "relationship:rId1", F.lit('https://example.org/"x"')), row("word/document.xml", "1", texts(" <", F.col("text"), "> ")))).alias("e")).select("doc_id", "e.*")
    out = writers.write_back(files.select("doc_id", "source_bytes"), edits, "docx", source_col="source_bytes")
    return docx(out.withColumnRenamed("output", "source_bytes"), external_links=True).select("doc_id", F.col("metadata")["part"].alias("part"), ops.text_of(codes=True).alias("unit_text"))


@query("SELECT conv_id || '-' || turn AS doc_id, 0 AS field_id, NULL::INT AS parent_id, 1 AS depth, 'REF ' || role AS instruction, text AS result, NULL AS error FROM conversations UNION ALL SELECT conv_id || '-' || turn, 1, 0, 2, 'PAGE', '2', NULL FROM conversations")
def docx_fields(spark, sf_dir):
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    body = texts("<w:p>", mark("begin"), "<w:r><w:instrText>REF ", escaped("role"), "</w:instrText></w:r>", mark("begin"), "<w:r><w:instrText>PAGE</w:instrText></w:r>", mark("separate"), "<w:r><w:t>2</w:t></w:r>", mark("end"), mark("separate"), "</w:p><w:p><w:r><w:t>", escaped("text"), "</w:t></w:r>", mark("end"), "</w:p>")
    return fields.complex_fields(parse(words(spark, sf_dir, body), "docx", source_col="source_bytes"))


@query("SELECT n_nationkey::VARCHAR AS style_id, CASE WHEN n_nationkey < 5 THEN 'own=' || n_nationkey || ',root=' || n_nationkey ELSE 'own=' || n_nationkey || ',root=' || (n_nationkey % 5) END AS look FROM nation")
def style_looks(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    run = F.when(F.col("n_nationkey") < 5, F.create_map(F.lit("root"), key, F.lit("own"), key)).otherwise(F.create_map(F.lit("own"), key))
    looks = catalog.resolve_looks(n.select(key.alias("style_id"), F.lit("paragraph").alias("type"), F.when(F.col("n_nationkey") >= 5, (F.col("n_nationkey") - 5).cast("string")).alias("based_on"), run.alias("run")))
    return looks.select("style_id", F.array_join(F.array_sort(F.transform(F.map_entries("look"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("look"))


X1 = '<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2"><file><body><trans-unit id="'


@query(f"""SELECT conv_id || '-' || turn AS doc_id, '{X1}' || turn || '"><source>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<ph id="1"/></source><target>new <g/></target></trans-unit></body></file></xliff>' AS output FROM conversations""")
def xliff_patch(spark, sf_dir):
    docs = xliff_docs(spark, sf_dir)
    edits = ops.units(parse(docs, "xliff")).select("doc_id", F.col("unit_id").alias("key1"), F.lit("target").alias("key2"), F.lit("new <g/>").alias("replacement"))
    return writers.write_back(docs, edits, "xliff").drop("error")


X2 = '<x:xliff version="2.0" xmlns:x="urn:oasis:names:tc:xliff:document:2.0"><x:file id="f"><!-- <x:unit id="u"><x:segment/></x:unit> --><x:unit id="u"><x:segment id="s1"><x:source>one</x:source></x:segment><x:segment><x:source>two</x:source><x:target>old</x:target></x:segment></x:unit></x:file></x:xliff>'
X2_NEW = X2.replace("one</x:source>", "one</x:source><x:target>{0}</x:target>").replace("two", "zwei").replace("old", "{1}")


@query("SELECT conv_id || '-' || turn AS doc_id, replace(replace('" + X2_NEW + "', '{0}', role), '{1}', turn::VARCHAR) AS output FROM conversations")
def xliff2_patch(spark, sf_dir):
    docs = turns(spark, sf_dir).select("doc_id", "role", "turn", F.lit(X2).alias("source_text"))
    row = lambda segment, new: F.struct(F.lit("u").alias("key1"), F.lit(segment).alias("key2"), new.alias("replacement"))
    edits = docs.select("doc_id", F.explode(F.array(row("s1", F.col("role")), row("1", F.col("turn").cast("string")), row("1/source", F.lit("zwei")))).alias("e")).select("doc_id", "e.*")
    return writers.write_back(docs, edits, "xliff2").drop("error")


@query("SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || '!' AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def epub_patch(spark, sf_dir):
    books = spread(read(spark, sf_dir, "pages")).select("page_id", zipped("html").alias("source_bytes"))
    is_title = F.col("metadata")["html_element"] == "title"
    found = ops.units(parse(books, "epub", "page_id", "source_bytes")).filter(is_title)
    edits = found.select("doc_id", F.col("metadata")["epub_path"].alias("key1"), F.col("unit_id").alias("key2"), F.concat(ops.text_of(), F.lit("!")).alias("replacement"))
    out = writers.write_back(books, edits, "epub", "page_id", "source_bytes")
    again = ops.units(parse(out, "epub", "doc_id", "output")).filter(is_title)
    return again.select(F.col("doc_id").cast("long").alias("doc_id"), ops.text_of().alias("title"))


@F.pandas_udf(StringType())
def yaml_literals(values: pd.Series, styles: pd.Series, literals: pd.Series) -> pd.Series:
    return pd.Series([writers.yaml_literal(v, s, x) for v, s, x in zip(values, styles, literals, strict=True)], dtype=object)


@query(r"""SELECT n_nationkey AS doc_id, '# one' || chr(10) || 'name: ' || n_name || ' x' || chr(10) || 'quoted: ''it''''s x''' || chr(10) || 'double: "a b x"' || chr(10) || 'number: "1 x"' || chr(10) || 'block: |' || chr(10) || '    text' || chr(10) || '     x' || chr(10) || 'same: &a kept' || chr(10) || 'other: *a' || chr(10) AS output FROM nation""")
def yaml_patch(spark, sf_dir):
    """Edited scalars keep style and indent; a plain one that would no longer be text is quoted; aliases share their unit."""
    n = read(spark, sf_dir, "nation")
    docs = n.select(F.col("n_nationkey").alias("doc_id"), texts("# one\nname: ", F.col("n_name"), "\nquoted: 'it''s'\ndouble: \"a b\"\nnumber: 1\nblock: |\n    text\nsame: &a kept\nother: *a\n").alias("source_text"))
    found = ops.units(parse(docs, "yaml")).withColumn("t", ops.text_of())
    m = F.col("metadata")
    new = F.when(F.col("t") == "kept", F.col("t")).when(F.col("t") == "1", F.lit("1 x")).when(m["scalar_style"] == "|", F.lit("text\n x\n")).otherwise(F.concat("t", F.lit(" x")))
    edits = found.withColumn("new", new).filter("new <> t")
    forced = F.when(F.col("t") == "1", F.lit('"')).otherwise(m["scalar_style"])
    return patch.patch_spans(docs, edits.select("doc_id", "span_start", "span_end", F.lit(None).cast("string").alias("original"), yaml_literals("new", forced, m["literal"]).alias("replacement")))


@query("SELECT n_nationkey AS id, 'Nation ' || n_name AS title, 'a.B,a.C' AS classes FROM nation")
def jar_classes(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    names = ["META-INF/MANIFEST.MF", "a/C.class", "a/B.class", "README"]
    jars = n.select(F.col("n_nationkey").alias("id"), package(F.array(*map(F.lit, names)), F.array(texts("Manifest-Version: 1.0\r\nImplementation-Title: Nation\r\n  ", F.col("n_name"), "\r\n\r\nName: x\r\n"), F.lit(""), F.lit(""), F.lit("r"))).alias("content"))
    found = packages.inspect_jars(jars, "id")
    return found.select("id", F.col("manifest")["Implementation-Title"].alias("title"), F.array_join("classes", ",").alias("classes"))


@query("SELECT doc_id, 'line-' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit_id, line AS unit_text FROM (SELECT doc_id, u.i AS i, u.line AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents)) WHERE trim(line) <> '' AND line NOT LIKE '    %'")
def prototype_lines(spark, sf_dir):
    found = ops.units(parse(spread(read(spark, sf_dir, "documents")), "lines", source_col="text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "unit_id", ops.text_of(codes=True).alias("unit_text"))

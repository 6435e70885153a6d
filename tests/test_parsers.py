import io
import json
import struct
import zipfile

import pytest
from folioflow.operators import catalog, fields, patch, units, writers
from folioflow.schema import event
from folioflow.sources import packages, parsers
from folioflow.sources import word as word_parser
from folioflow.sources.parsers import PARSERS
from folioflow.sources.reader import parse
from folioflow.streaming import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def texts(fmt, source, **o):
    return ["".join(p["text"] or "" for p in e["parts"]) for e in PARSERS[fmt](source, **o) if e["event_type"] == "TEXT_UNIT"]


def metas(fmt, source, **o):
    return [e["metadata"] for e in PARSERS[fmt](source, **o) if e["event_type"] == "TEXT_UNIT"]


def test_html_units():
    page = "<html><body><h2>Tide tables</h2><div>High <em>water</em>!</div><style>p{}</style></body></html>"
    assert texts("html", page) == ["Tide tables", "High water!"]
    assert [m["html_element"] for m in metas("html", page)] == ["h2", "div"]
    assert texts("html", "<p> </p><p>a &amp; b</p>tail") == ["a &amp; b", "tail"]


MARKS = ["<p>", "</p>", "<div a='>'>", "<b>", "</b>", "<br/>", "<?php x ?>", "<![CDATA[z]]>", "<!-- c -->", "<!DOCTYPE html>", "text", " ", "&amp;", "&#65;", "\n", "<script>x<y</script>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKS), max_size=14))
def test_html_units_write_back_byte_for_byte(pieces):
    page = "".join(pieces)
    for e in PARSERS["html"](page):
        assert "".join(p["text"] or p["data"] or "" for p in e["parts"]) == page[e["span_start"] : e["span_end"]]


@pytest.mark.parametrize(
    ("source", "options", "expected"),
    [
        ('{"port": "Cork", "boat": "Gull"}', {}, ["Cork", "Gull"]),
        ('{"boat": "Gull", "crew": ["Ann", "Bo"]}', {"extractAllPairs": False}, []),
        ('{"boat": "Gull", "crew": ["Ann", "Bo"]}', {"extractAllPairs": False, "extractStandalone": True}, ["Ann", "Bo"]),
        ('{"x_code": "7", "label": "y"}', {"exceptions": "x_"}, ["y"]),
        ('{"x_code": "7", "label": "y"}', {"extractAllPairs": False, "exceptions": "x_"}, ["7"]),
        ('{"a": 1, "b": true, "c": null, "d": {}, "e": []}', {}, []),
        ('"alone"', {"extractStandalone": True}, ["alone"]),
        ('{"a": "b"}' + " " * 200 + "\n", {}, ["b"]),
    ],
)
def test_json_rules(source, options, expected):
    assert texts("json", source, **options) == expected


def test_json_names_and_facts():
    assert metas("json", '{"key": "k1", "part": {"key": "k2", "say": "Ahoy"}}', idRules="key", useIdStack=True)[0]["name"] == "k1/k2"
    assert metas("json", '{"a": {"b": ["x"]}}', extractStandalone=True)[0]["json_path"] == "/a/b/0"
    found = metas("json", '{"hint": "N", "w": 10, "ok": true, "t": "T"}', noteRules="hint", maxwidthRules="w", genericMetaRules="ok")
    assert [(m["notes"], m["max_width"], m["size_unit"], m["generic_meta"]) for m in found] == [('[{"from": "hint", "text": "N"}]', "10", "", '{"ok": "true"}')]
    parts = next(PARSERS["json"]('{"say": "row <i>on</i>"}', useCodeFinder=True))["parts"]
    assert [(p["ptype"], p["text"] or p["data"]) for p in parts] == [("text", "row "), ("code", "<i>"), ("text", "on"), ("code", "</i>")]
    assert len(next(PARSERS["json"]('{"say": "a%sb"}', useCodeFinder=True, codeFinderRules="%s"))["parts"]) == 3
    kinds = [e["event_type"] for e in PARSERS["json"]('{"page": "<p>a</p>", "b": "c"}', subfilter="html", subfilterRules="page")]
    assert kinds == ["START_SUBFILTER", "TEXT_UNIT", "END_SUBFILTER", "TEXT_UNIT"]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from('{}[],:"ab1 tn\\'), max_size=14) | st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8).map(json.dumps))
def test_json_is_taken_as_the_standard_reads_it(source):
    try:
        value, good = json.loads(source, strict=False), True
    except ValueError:
        value, good = None, False
    try:
        found, taken = list(parsers.json_values(source)), True
    except ValueError:
        found, taken = [], False
    assert taken == good

    def strings(v):
        return [v] if isinstance(v, str) else [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) for s in strings(x)]

    if good and len({f["path"] for f in found}) == len(found):
        assert [f["value"] for f in found if f["is_string"]] == strings(value) or '": ' not in source


def test_yaml_xliff():
    assert [m["yaml_path"] for m in metas("yaml", "ship:\n  name: A\n  decks: [x, y]\n")] == ["ship/name", "ship/decks/0", "ship/decks/1"]
    assert texts("yaml", "name: Gull\nmasts: 3\nflag: null\nsame: &a x\nother: *a\n") == ["Gull", "3", "x"]
    found = next(PARSERS["xliff"]('<xliff><file source-language="en" target-language="fr"><trans-unit id="1"><source>Row <ph id="1"/> hard</source></trans-unit></file></xliff>'))
    assert [(p["kind"], p["text"]) for p in found["parts"]] == [(None, "Row "), ("empty", None), (None, " hard")]
    assert (found["metadata"]["source_language"], found["metadata"]["target_language"]) == ("en", "fr")
    with pytest.raises(ValueError):
        list(PARSERS["xliff2"]("<xliff/>"))


def test_markdown():
    assert len(texts("markdown", "# Ahoy\n\nAll", compat=True)) == 3
    assert len(texts("markdown", "# Ahoy\n\nAll")) == 2
    parts = next(PARSERS["markdown"]("**b** [t](http://a.b) `c`"))["parts"]
    assert [(p["kind"], p["target"]) for p in parts if p["ptype"] == "code"] == [("bold", None), ("link", "http://a.b"), ("inline_code", None)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab *`[]()!#->\n~."), max_size=60), st.booleans())
def test_markdown_is_lossless(source, compat):
    out = "".join(e["content"] if e["parts"] is None else "".join(p["text"] or p["data"] for p in e["parts"]) for e in PARSERS["markdown"](source, compat=compat))
    assert out == source


def word(body, **more):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        for name, data in more.items():
            z.writestr(name.replace("__", "/"), data)
    return held.getvalue()


def test_docx():
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = (
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr>{run.format("A")}</w:p>'
        f'<w:p>{run.format("x")}<w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:ins>{run.format("in")}</w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run.format('cell')}</w:p></w:tc></w:tr></w:tbl>"
        f'<w:p><w:hyperlink r:id="rId1">{run.format("go")}</w:hyperlink></w:p>'
    )
    rels = '<Relationships><Relationship Id="rId1" Target="https://example.com"/></Relationships>'
    data = word(body, **{"word___rels__document.xml.rels": rels})
    found = list(PARSERS["docx"](data))
    assert texts("docx", data) == ["A", "xin", "cell", ""]
    assert (found[0]["metadata"]["num_id"], found[0]["metadata"]["num_level"]) == ("3", "1")
    assert (found[2]["metadata"]["table"], found[2]["metadata"]["cell"]) == ("0", "0")
    assert [(p["kind"], p["target"]) for p in found[3]["parts"]] == [("hyperlink", "https://example.com")]
    patched = writers.patch_docx(data, {("word/document.xml", "2"): " new & old "})
    assert texts("docx", patched) == ["A", "xin", " new & old ", ""]
    before, after = (zipfile.ZipFile(io.BytesIO(x)).read("word/document.xml").decode() for x in (data, patched))
    assert after == before.replace("<w:t>cell</w:t>", '<w:t xml:space="preserve"> new &amp; old </w:t>')
    with pytest.raises(ValueError):
        writers.patch_docx(data, {("word/document.xml", "99"): "x"})


def test_docx_notes_count_over_the_part():
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    notes = f'<w:footnotes {space}><w:footnote w:id="0"><w:p><w:r><w:t>line</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    data = word("", **{"word__footnotes.xml": notes})
    m = metas("docx", data)[0]
    patched = writers.patch_docx(data, {(m["source_part_name"], m["source_paragraph_index"]): "edited"})
    assert texts("docx", patched) == ["edited"] and b">line<" in zipfile.ZipFile(io.BytesIO(patched)).read("word/footnotes.xml")


def test_styles():
    rows = [
        {"style_id": None, "run": {"size": "20"}, "type": None, "based_on": None, "linked": None, "is_default": False},
        {"style_id": "P", "run": {"bold": "true", "font": "A"}, "type": "paragraph", "based_on": None, "linked": None, "is_default": True},
        {"style_id": "Q", "run": {"bold": "false"}, "type": "paragraph", "based_on": "P", "linked": None, "is_default": False},
        {"style_id": "C", "run": {"italic": "true"}, "type": "character", "based_on": "P", "linked": "Q", "is_default": False},
    ]
    s = word_parser.Styles(rows)
    assert s.look("Q") == {"size": "20", "bold": "false", "font": "A"}
    assert s.look(None, "C", {"size": "9"}) == {"size": "9", "bold": "false", "font": "A", "italic": "true"}
    with pytest.raises(ValueError):
        word_parser.Styles([rows[1] | {"based_on": "Q"}, rows[2]]).look("Q")
    assert [word_parser.Rules({"highlight_colors": ["yellow"], "highlight_mode": m}).run_out(None, {"highlight": h}, None) for m in ("exclude", "include") for h in ("#FFFF00", "red")] == [True, False, False, True]


def test_fields():
    found = fields.fields_of([("field_char", "begin"), ("field_instruction", "HYPERLINK"), ("field_char", "separate"), ("text", "a"), ("field_char", "begin"), ("field_instruction", "PAGE"), ("field_char", "separate"), ("text", "2"), ("field_char", "end"), ("field_char", "end")])
    assert [(f["instruction"], f["result"], f["depth"], f["parent_id"]) for f in found] == [("HYPERLINK", "a2", 1, None), ("PAGE", "2", 2, 0)]
    with pytest.raises(ValueError):
        fields.fields_of([("field_char", "end")])


def test_writers():
    source = '<x:xliff xmlns:x="u"><!-- <x:trans-unit id="1"><x:source>no</x:source></x:trans-unit> --><x:trans-unit id="1"><x:source>a</x:source><x:alt-trans><x:target>alt</x:target></x:alt-trans></x:trans-unit><x:trans-unit id="2"><x:source>b</x:source><x:target state="n">c</x:target></x:trans-unit><x:trans-unit id="3"><x:source>d</x:source><x:target/></x:trans-unit></x:xliff>'
    out = writers.patch_xliff(source, {("1", "target"): "A", ("2", "target"): "C", ("2", "source"): "B", ("3", "target"): "D"})
    assert out == source.replace("<x:source>a</x:source>", "<x:source>a</x:source><x:target>A</x:target>").replace(">b<", ">B<").replace(">c<", ">C<").replace("<x:target/>", "<x:target>D</x:target>")
    two = '<xliff><unit id="u"><segment id="s"><source>a</source></segment><segment><source>b</source></segment></unit><unit id="v"><segment id="s"><source>c</source></segment></unit></xliff>'
    assert writers.patch_xliff2(two, {("u", "1", "target"): "B", ("v", "s", "target"): "C"}) == two.replace("<source>b</source>", "<source>b</source><target>B</target>").replace("<source>c</source>", "<source>c</source><target>C</target>")
    assert [writers.yaml_literal(v, st_, x) for v, st_, x in (("it's", "'", "'a'"), ("no", "plain", "x"), ("a: b", "plain", "x"), ("fine", "plain", "x"), ("p\n\nq\n", "|", "|\n   z\n"))] == ["'it''s'", '"no"', '"a: b"', "fine", "|\n   p\n\n   q\n"]
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr("OEBPS/chapter.xhtml", "<p>Hello</p><p>Second</p>")
        z.writestr("OEBPS/image.png", b"\x00")
    book = writers.patch_epub(held.getvalue(), {("OEBPS/chapter.xhtml", "1"): "Changed"})
    assert [e["metadata"]["epub_path"] for e in PARSERS["epub"](book)] == ["OEBPS/chapter.xhtml"] * 2
    assert texts("epub", book) == ["Changed", "Second"]


def test_jar(spark):
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\r\nImplementation-Version: 1.2\r\n .3\r\n\r\n")
        z.writestr("b/B.class", b"")
        z.writestr("a/A.class", b"")
    files = spark.createDataFrame([("x.jar", held.getvalue()), ("y.jar", b"no")], "path string, content binary")
    rows = {r["path"]: r for r in packages.inspect_jars(files).collect()}
    assert rows["x.jar"]["classes"] == ["a.A", "b.B"]
    assert rows["x.jar"]["manifest"]["Implementation-Version"] == "1.2.3"
    assert rows["y.jar"]["error"].startswith("BadZipFile")


def test_class_header():
    names = ["a/B", "java/lang/Object", "run", "()V"]
    pool = b"".join(b"\x01" + struct.pack(">H", len(n)) + n.encode() for n in names) + b"\x07\x00\x01\x07\x00\x02"
    data = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, 7) + pool + struct.pack(">HHHH", 0, 5, 6, 0) + struct.pack(">H", 0) + struct.pack(">H", 1) + struct.pack(">HHHH", 0, 3, 4, 0)
    assert packages.class_header(data) == {"class_name": "a/B", "super_name": "java/lang/Object", "methods": ["run()V"]}


def test_bad_document_is_a_row(spark):
    docs = spark.createDataFrame([("1", '{"a": "b"}'), ("2", "{"), ("3", None)], "doc_id string, source_text string")
    rows = {r["doc_id"]: r for r in parse(docs, "json").collect()}
    assert rows["1"]["status"] == "COMPLETED"
    assert rows["2"]["error_code"] == "EXECUTION_FAILED"
    assert "3" not in rows


def test_patch_rejects_overlaps(spark):
    docs = spark.createDataFrame([("1", "a😀bcd")], "doc_id string, source_text string")
    edits = spark.createDataFrame([("1", 1, 2, "😀", "XY"), ("1", 3, 4, "c", "")], "doc_id string, span_start int, span_end int, original string, replacement string")
    assert patch.patch_spans(docs, edits).first()["output"] == "aXYbd"
    bad = edits.withColumn("span_end", F.lit(4))
    with pytest.raises(Exception, match="overlapping"):
        patch.patch_spans(docs, bad).collect()


def test_balanced_and_cycles(spark):
    rows = [("1", 0, "START_DOCUMENT"), ("1", 1, "END_DOCUMENT"), ("2", 0, "END_GROUP"), ("2", 1, "START_GROUP")]
    found = units.balanced(spark.createDataFrame(rows, "doc_id string, seq int, event_type string"))
    assert {r["doc_id"]: r["balanced"] for r in found.collect()} == {"1": True, "2": False}
    loop = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a")], "style_id string, type string, based_on string")
    with pytest.raises(Exception, match="style cycle"):
        catalog.resolve_chain(loop).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": "b"}')
    stream = documents.read_folder(spark, str(tmp_path / "in"), "json")
    documents.write_events(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("event_type = 'TEXT_UNIT'").count() == 1


def test_event_defaults():
    assert event("START_DOCUMENT")["parts"] is None

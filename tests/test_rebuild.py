import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pytest
from folioflow.operators import rebuild
from folioflow.operators.units import split_across
from folioflow.schema import code, markup, text
from folioflow.sources.markup import components
from folioflow.sources.parsers import PARSERS
from folioflow.sources.word import parse_docx
from hypothesis import given, settings
from hypothesis import strategies as st

ALL_CODES = [
    code("begin", "field_char"), code(" PAGE ", "field_instruction"), code("", "tab"), code("page", "line_break"), code("", "no_break_hyphen"), code("mark", "bookmark_start", "5"),
    code("5", "bookmark_end"), code("2", "footnote"), code("3", "endnote"), code("7", "protected"), code("home", "hyperlink", "https://example.org/?a=1&b=2"), code("%1", "level_number"),
]


def part_of(package, name="word/document.xml"):
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        return z.read(name).decode()


def test_every_code_kind_is_read_again():
    found = list(parse_docx(rebuild.build_docx([([text("a "), *ALL_CODES, text(" b")], {})])))
    kinds = [p["kind"] for p in found[0]["parts"] if p["ptype"] == "code"]
    assert kinds == [c["kind"] for c in ALL_CODES[:-1]]
    assert [p["text"] for p in found[0]["parts"] if p["ptype"] == "text"] == ["a ", "%1", " b"]
    assert [p["target"] for p in found[0]["parts"] if p["kind"] in ("hyperlink", "bookmark_start")] == ["5", "https://example.org/?a=1&b=2"]


def test_links_to_one_target_share_a_relationship_and_markup_closes():
    link = markup("start", "w:hyperlink") | {"target": "https://example.org/x"}
    made = rebuild.build_docx([([link, text("a"), text("b")], {}), ([code("c", "hyperlink", "https://example.org/x"), markup("end", "w:hyperlink")], {}), ([code("d", "hyperlink", "urn:y")], {})])
    assert [r.get("Id") for r in ET.fromstring(part_of(made, "word/_rels/document.xml.rels"))] == ["rIdHyper1", "rIdHyper2"]
    assert re.findall(r'r:id="(\w+)"', part_of(made)) == ["rIdHyper1", "rIdHyper1", "rIdHyper2"]


def test_looks_stand_in_the_order_of_the_format():
    marks = {"underline": "single", "bold": "true", "italic": "false", "font_cs": "Serif", "font": "Sans", "run_style": "Strong", "resolved_size": "9"}
    assert rebuild.looks_of(marks) == '<w:rPr><w:rStyle w:val="Strong"/><w:rFonts w:ascii="Sans" w:cs="Serif"/><w:b/><w:i w:val="false"/><w:u w:val="single"/></w:rPr>'
    assert rebuild.looks_of({"resolved_size": "9"}) == ""


def test_parts_tables_boxes_and_lists():
    rows = [
        ([text("t")], {"part": "core_properties", "source_element_tag": "title"}),
        ([code("%1", "level_number"), text(")")], {"part": "numbering", "num_id": "4", "num_level": "0"}),
        ([text("i")], {"part": "body", "num_id": "4", "num_level": "0"}),
        *[([text(f"{t}{r}{c}")], {"part": "body", "table": str(t), "row": str(r), "cell": str(c)}) for t in (0, 1) for r in (0, 1) for c in (0, 1)],
        ([text("x")], {"part": "body", "text_box": "0", "text_box_host": "9", "textbox_vml": "true"}),
        ([text("y")], {"part": "body", "text_box": "0", "text_box_host": "11"}),
        ([text("h")], {"part": "header", "source_part_name": "word/header1.xml"}),
        ([text("g")], {"part": "header", "source_part_name": "word/header2.xml"}),
        ([text("f")], {"part": "footer"}),
        ([text("n1")], {"part": "endnote", "note_id": "2"}),
        ([text("n2")], {"part": "endnote", "note_id": "3"}),
        ([text("n3")], {"part": "endnote", "note_id": "2"}),
        ([text("c")], {"part": "comment", "comment_id": "0"}),
    ]
    made = rebuild.build_docx(rows)
    again = [("".join(p["text"] or p["data"] for p in u["parts"]), u["metadata"]) for u in parse_docx(made, numbering_texts=True)]
    assert [t for t, _ in again] == ["t", "%1)", "i", "000", "001", "010", "011", "100", "101", "110", "111", "x", "y", "f", "h", "g", "n1", "n3", "n2", "c"]
    assert [(m["table"], m["row"], m["cell"]) for _, m in again if "table" in m] == [(str(t), str(r), str(c)) for t in (0, 1) for r in (0, 1) for c in (0, 1)]
    boxes = [m for _, m in again if "text_box" in m]
    assert [sorted(k for k in m if k.startswith("textbox_")) for m in boxes] == [["textbox_vml"], ["textbox_drawingml", "textbox_vml"]]
    kinds = {o.get("PartName") for o in ET.fromstring(part_of(made, "[Content_Types].xml")) if o.get("PartName")}
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert kinds == {f"/{n}" for n in z.namelist() if "rels" not in n and "Types" not in n}


def test_what_xml_cannot_hold_is_an_error():
    with pytest.raises(ValueError):
        rebuild.build_docx([([text("a\x01")], {})])
    assert list(parse_docx(rebuild.build_docx([]))) == []


def test_errors_are_rows(spark):
    rows = [("a", 1, [text("one")]), ("a", 0, [text("zero")]), ("b", 0, [text("\x02")])]
    from folioflow.schema import PART

    events = spark.createDataFrame(rows, f"doc_id string, seq int, parts array<{PART}>").selectExpr("*", "'TEXT_UNIT' event_type", "cast(null as map<string,string>) metadata")
    found = {r.doc_id: r for r in rebuild.rebuild_docx(events).collect()}
    assert [u["parts"][0]["text"] for u in parse_docx(bytes(found["a"].output))] == ["zero", "one"]
    assert found["b"].output is None and found["b"].error.startswith("ValueError")


def naive_codes(parts, rules):
    """Each character of the runs marked with the match that holds it."""
    whole = "".join(p["text"] for p in parts if p["ptype"] == "text")
    owner, free = [None] * len(whole), 0
    for a, b in sorted((m.start(), m.end()) for r in rules for m in r.finditer(whole)):
        if a >= free and b > a:
            owner[a:b] = [(a, b)] * (b - a)
            free = b
    out, at = [], 0
    for p in parts:
        if p["ptype"] != "text":
            out.append(("code", p["data"]))
            continue
        plain = ""
        for i in range(at, at + len(p["text"])):
            if owner[i] is None:
                plain += whole[i]
                continue
            out += [("text", plain)] if plain else []
            plain = ""
            out += [("code", whole[slice(*owner[i])])] if i == owner[i][0] else []
        out += [("text", plain)] if plain or not p["text"] else []
        at += len(p["text"])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab<>{}"), max_size=6).map(text) | st.just(code("", "tab")), max_size=6))
def test_codes_across_runs(parts):
    rules = [re.compile(r"<a*>"), re.compile(r"\{[^}]*\}"), re.compile("b*")]
    assert [(p["ptype"], p["data"] if p["ptype"] == "code" else p["text"]) for p in split_across(parts, rules)] == naive_codes(parts, rules)


def test_components_of_a_deep_tree():
    deep = 5000
    rows = list(components(ET.fromstring("<a>" * deep + "</a>" * deep)))
    assert len(rows) == 2 * deep and rows[-1]["matches"] == "mc-1" and rows[deep - 1]["parent_id"] == f"mc-{deep - 1}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a*`"), max_size=12))
def test_tokens_write_back(source):
    found = next(PARSERS["tokens"](source))["parts"]
    assert "".join(p["text"] or p["data"] or "" for p in found) == source
    marks = [p["data"] for p in found if p["ptype"] == "code"]
    assert marks[::2] == marks[1::2]


def test_tokens_by_rule():
    found = next(PARSERS["tokens"]("x **b *i** `c` **", rules=("CODE", "STRONG_EMPHASIS")))["parts"]
    assert [(p["kind"], p["text"] or p["data"]) for p in found] == [(None, "x "), ("bold", "**"), (None, "b *i"), ("bold", "**"), (None, " "), ("inline_code", "`"), (None, "c"), ("inline_code", "`"), (None, " **")]
    assert [p["text"] for p in next(PARSERS["tokens"]("**a**", rules=()))["parts"]] == ["**a**"]

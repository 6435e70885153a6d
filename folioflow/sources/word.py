"""Word-processing packages to units: text, codes, run properties, styles, numbering, text boxes, notes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from ..schema import code, markup, text, unit
from .parsers import local

# OOXML name spaces, element and property names.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HYPERLINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
CORE = ("title", "subject", "creator", "description", "category", "contentStatus", "keywords")
TOGGLES = {"b": "bold", "i": "italic", "strike": "strike", "vanish": "hidden"}
SCALARS = {"u": "underline", "color": "color", "sz": "size", "szCs": "size_cs", "highlight": "highlight", "vertAlign": "vert_align", "rStyle": "run_style"}
FONTS = ("ascii", "hAnsi", "cs", "eastAsia")
FONT_MARKS = ("asciiTheme", "hAnsiTheme", "cstheme", "eastAsiaTheme", "hint")
COLORS = {"black": "000000", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "white": "ffffff", "cyan": "00ffff", "magenta": "ff00ff"}
PLAIN_CODES = {"tab": "tab", "br": "line_break", "noBreakHyphen": "no_break_hyphen", "bookmarkStart": "bookmark_start", "bookmarkEnd": "bookmark_end"}


def val(el: ET.Element | None, default: str | None = None) -> str | None:
    return default if el is None else el.get(f"{W}val", default)


def run_look(rpr: ET.Element | None, every_font: bool = True) -> dict[str, str]:
    """Property map of an rPr element; all font categories where they are told apart."""
    look: dict[str, str] = {}
    for el in rpr if rpr is not None else ():
        name = local(el.tag)
        if name in TOGGLES:
            look[TOGGLES[name]] = "false" if val(el) in ("0", "false", "off", "no") else "true"
        elif name == "u":
            look["underline"] = val(el, "single")
        elif name in SCALARS and val(el) is not None:
            look[SCALARS[name]] = val(el)
        elif name == "rFonts":
            set_ = {a: el.get(f"{W}{a}") for a in (*FONTS, *FONT_MARKS) if el.get(f"{W}{a}")}
            if every_font and (len(set_) > 1 or set_.keys() & set(FONT_MARKS)):
                look |= {f"font_{a}": v for a, v in set_.items()}
            first = next((set_[a] for a in FONTS if a in set_), None)
            look |= {"font": first} if first else {}
    return look


def style_rows(xml: bytes | str) -> list[dict]:
    """A row per style of a styles part, and one with style_id null that holds the document's defaults."""
    root = ET.fromstring(xml)
    kept = {"type": None, "based_on": None, "linked": None, "is_default": False, "paragraph": {}}
    rows = [kept | {"style_id": None, "run": run_look(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"), False)}]
    for el in root.findall(f"{W}style"):
        if el.get(f"{W}styleId"):
            paragraph = {local(c.tag): val(c, "true") for c in el.find(f"{W}pPr") if True} if el.find(f"{W}pPr") is not None else {}
            rows.append(
                {
                    "style_id": el.get(f"{W}styleId"), "type": el.get(f"{W}type", "paragraph"), "based_on": val(el.find(f"{W}basedOn")), "linked": val(el.find(f"{W}link")),
                    "is_default": el.get(f"{W}default") in ("1", "true", "on"), "run": run_look(el.find(f"{W}rPr"), False), "paragraph": paragraph,
                }
            )
    return rows


class Styles:
    """Looks of runs: document defaults, paragraph style, the paragraph style that a character style is linked to, character style, own properties."""

    def __init__(self, rows: list[dict]):
        self.defaults = next((r["run"] for r in rows if r["style_id"] is None), {})
        self.by_id = {r["style_id"]: r for r in rows if r["style_id"]}
        self.flat: dict[str, dict] = {}

    def of(self, style_id: str | None, kind: str) -> str | None:
        """The style itself if it is of the kind, else the kind's default one."""
        if style_id in self.by_id and self.by_id[style_id]["type"] == kind:
            return style_id
        return next((i for i, r in self.by_id.items() if r["type"] == kind and r["is_default"]), None)

    def inherited(self, style_id: str) -> dict[str, str]:
        if style_id not in self.flat:
            way, at = [], style_id
            while at is not None:
                if at in way:
                    raise ValueError(f"styles are based on each other in a circle at {at}")
                way.append(at)
                up = self.by_id[at]["based_on"]
                at = up if up in self.by_id and self.by_id[up]["type"] == self.by_id[at]["type"] else None
            look: dict[str, str] = {}
            for i in reversed(way):
                look = look | self.by_id[i]["run"]
            self.flat[style_id] = look
        return self.flat[style_id]

    def look(self, paragraph: str | None, run: str | None = None, own: dict | None = None) -> dict[str, str]:
        out = dict(self.defaults)
        base, char = self.of(paragraph, "paragraph"), self.of(run, "character")
        linked = self.by_id[char]["linked"] if char else None
        for i in (base, self.of(linked, "paragraph") if linked in self.by_id and self.by_id[linked]["type"] == "paragraph" else None, char):
            out |= self.inherited(i) if i else {}
        return out | (own or {})


def canonical_color(value: str) -> str:
    return COLORS.get(value.strip().lower(), value.strip().lower().lstrip("#"))


class Rules:
    """What is not translated: styles, colours and highlights, listed to leave out or, in include mode, to keep alone."""

    def __init__(self, o: dict):
        self.styles, self.include = set(o.get("exclude_styles") or ()), o.get("style_mode") == "include"
        self.colors = {canonical_color(c) for c in o.get("exclude_colors") or ()}
        self.highlights, self.highlight_include = {canonical_color(c) for c in o.get("highlight_colors") or ()}, o.get("highlight_mode") == "include"

    def paragraph_out(self, style: str | None) -> bool:
        return bool(style and self.styles) and (style in self.styles) != self.include

    def run_out(self, paragraph: str | None, look: dict, own_style: str | None) -> bool:
        style = own_style or paragraph
        if self.styles and ((style in self.styles) != self.include if style else self.include):
            return True
        if look.get("color") is not None and canonical_color(look["color"]) in self.colors:
            return True
        listed = look.get("highlight") is not None and canonical_color(look["highlight"]) in self.highlights
        return not listed if self.highlight_include else listed


class Part:
    """One XML part: its paragraphs by place among all of its paragraphs, links, cells and text boxes."""

    def __init__(self, root: ET.Element, name: str, links: dict[str, str], styles: Styles, rules: Rules, hidden: bool):
        self.root, self.name, self.links, self.styles, self.rules, self.hidden = root, name, links, styles, rules, hidden
        self.place = {id(p): i for i, p in enumerate(root.iter(f"{W}p"))}
        self.cells: dict[int, dict] = {}
        for t, table in enumerate(root.iter(f"{W}tbl")):
            for r, row in enumerate(table.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    self.cells |= {id(p): {"table": str(t), "row": str(r), "cell": str(c)} for p in cell.findall(f"{W}p")}
        self.inside = {id(p) for box in root.iter(f"{W}txbxContent") for p in box.iter(f"{W}p")}

    def run(self, el: ET.Element, style: str | None) -> list[dict]:
        own = run_look(el.find(f"{W}rPr"))
        look = self.styles.look(style, own.get("run_style"), own)
        if look.get("hidden") == "true" and not self.hidden:
            return []
        out = self.rules.run_out(style, look, own.get("run_style"))
        marks = [{"k": k, "v": v} for k, v in own.items()]
        return [code(p["text"], "excluded_style") if out and p["ptype"] == "text" else p | ({"attributes": marks} if p["ptype"] == "text" else {}) for p in self.content(el, style)]

    def content(self, el: ET.Element, style: str | None) -> list[dict]:
        """Parts of inline content: inserted text stays, deleted text goes, references are codes."""
        out: list[dict] = []
        for c in el:
            name = local(c.tag)
            if name == "r":
                out += self.run(c, style)
            elif name == "hyperlink":
                inner, target = self.content(c, style), self.links.get(c.get(f"{R}id", ""))
                if len(inner) == 1 and inner[0]["ptype"] == "text":
                    out.append(code(inner[0]["text"], "hyperlink", target))
                else:
                    out += [markup("start", "w:hyperlink") | {"target": target}, *inner, markup("end", "w:hyperlink")]
            elif name == "t":
                out.append(text(c.text or ""))
            elif name in ("delText", "fldSimple"):
                out.append(code("".join(c.itertext()), "protected"))
            elif name == "instrText":
                out.append(code(c.text or "", "field_instruction"))
            elif name == "fldChar":
                out.append(code(c.get(f"{W}fldCharType", ""), "field_char"))
            elif name in ("footnoteReference", "endnoteReference"):
                out.append(code(c.get(f"{W}id", ""), name.removesuffix("Reference")))
            elif name in PLAIN_CODES:
                out.append(code(c.get(f"{W}name", c.get(f"{W}id", "")), PLAIN_CODES[name], c.get(f"{W}id") if name == "bookmarkStart" else None))
            elif name == "proofErr":
                out.append(markup("empty", "w:proofErr", [(local(k), v) for k, v in c.attrib.items()]))
            elif name in ("ins", "moveTo", "smartTag", "sdt", "sdtContent", "ruby", "rubyBase"):
                out += self.content(c, style)
        return out

    def paragraph(self, p: ET.Element, meta: dict) -> Iterator[tuple[list[dict], dict]]:
        style, num = val(p.find(f"{W}pPr/{W}pStyle")), p.find(f"{W}pPr/{W}numPr")
        if self.rules.paragraph_out(style):
            return
        own = meta | {"source_part_name": self.name, "source_paragraph_index": str(self.place[id(p)])} | self.cells.get(id(p), {})
        own |= {} if style is None else {"style": style}
        own |= {} if num is None else {"num_level": val(num.find(f"{W}ilvl"), "0"), "num_id": val(num.find(f"{W}numId"), "")}
        if parts := self.content(p, style):
            yield parts, own

    def boxes(self, p: ET.Element) -> list[list[tuple[str, ET.Element]]]:
        """Text boxes of a paragraph, each with its forms: a drawing and the older form of the same words are one box."""
        found: list[list[tuple[str, ET.Element]]] = []
        for holder in p.iter():
            form = {"txbx": "drawingml", "textbox": "vml"}.get(local(holder.tag))
            box = holder.find(f"{W}txbxContent") if form else None
            if box is None:
                continue
            words = ["".join(t.text or "" for t in q.iter(f"{W}t")) for q in box.iter(f"{W}p")]
            twin = next((f for f in found if len(f) == 1 and f[0][0] != form and ["".join(t.text or "" for t in q.iter(f"{W}t")) for q in f[0][1].iter(f"{W}p")] == words), None)
            if twin is not None:
                twin.append((form, box))
            else:
                found.append([(form, box)])
        return found

    def units(self, top: ET.Element, meta: dict, attributes: bool) -> Iterator[tuple[list[dict], dict]]:
        for p in top.iter(f"{W}p"):
            if id(p) in self.inside:
                continue
            yield from self.paragraph(p, meta)
            for k, forms in enumerate(self.boxes(p)):
                paired = [list(box.iter(f"{W}p")) for _, box in forms]
                for n, q in enumerate(paired[0]):
                    more = {"text_box": str(k), "text_box_host": str(self.place[id(p)])} | {f"textbox_{form}": "true" for form, _ in forms}
                    more |= {"paired_paragraph_index": str(self.place[id(paired[1][n])])} if len(paired) > 1 else {}
                    yield from self.paragraph(q, meta | more)
            for el in p.iter() if attributes else ():
                key = {"docPr": "name", "cNvPr": "name", "textpath": "string"}.get(local(el.tag))
                if key and el.get(key):
                    where = {"tag": local(el.tag), "attribute": key, "id": el.get("id"), "original": el.get(key)}
                    yield [text(el.get(key))], meta | {"source_part_name": self.name, "source_attribute_locators": json.dumps([where], ensure_ascii=False), "source_paragraph_index": str(self.place[id(p)])}


def level_texts(numbering: ET.Element, document: ET.Element) -> Iterator[tuple[list[dict], dict]]:
    """Texts of the list levels that paragraphs refer to, in the order of their first use; an override wins over the list's own."""
    texts: dict[tuple[str, str], str] = {}
    abstract = {(a.get(f"{W}abstractNumId"), lvl.get(f"{W}ilvl")): val(lvl.find(f"{W}lvlText")) for a in numbering.findall(f"{W}abstractNum") for lvl in a.findall(f"{W}lvl")}
    for num in numbering.findall(f"{W}num"):
        base = val(num.find(f"{W}abstractNumId"))
        own = {(num.get(f"{W}numId"), level): t for (a, level), t in abstract.items() if a == base}
        for over in num.findall(f"{W}lvlOverride"):
            value = val(over.find(f"{W}lvlText"), val(over.find(f"{W}lvl/{W}lvlText")))
            if value is not None:
                own[num.get(f"{W}numId"), over.get(f"{W}ilvl")] = value
        texts |= own
    asked = [(val(n.find(f"{W}numId"), ""), val(n.find(f"{W}ilvl"), "0")) for n in document.iter(f"{W}numPr")]
    for num_id, level in dict.fromkeys(asked):
        value = texts.get((num_id, level))
        if value is not None:
            parts = [code(x, "level_number") if re.fullmatch("%[1-9]", x) else text(x) for x in re.split("(%[1-9])", value) if x] or [text("")]
            yield parts, {"part": "numbering", "source_part_name": "word/numbering.xml", "num_id": num_id, "num_level": level, "source_original": value}


def parse_docx(source: bytes, **o) -> Iterator[dict]:
    """Core properties, external links, list texts, body with tables and text boxes, headers and footers, notes and comments, in this order.

    Paragraphs are located by their place among all of a part's paragraphs, whatever options leave out. Options:
    exclude_styles with style_mode (exclude or include), exclude_colors, highlight_colors with highlight_mode,
    include_hidden, include_headers_footers, include_comments, external_links, numbering_texts, attributes.
    """
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        names, rows = z.namelist(), []
        styles = Styles(style_rows(z.read("word/styles.xml")) if "word/styles.xml" in names else [])
        rules = Rules(o)

        def links(part_name: str) -> dict[str, str]:
            folder, base = part_name.rsplit("/", 1)
            own = f"{folder}/_rels/{base}.rels"
            found = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(own))} if own in names else {}
            return found or (links("word/document.xml") if part_name != "word/document.xml" else {})

        if "docProps/core.xml" in names:
            rows += [([text(el.text)], {"part": "core_properties", "source_part_name": "docProps/core.xml", "source_element_tag": local(el.tag)}) for el in ET.fromstring(z.read("docProps/core.xml")) if local(el.tag) in CORE and (el.text or "").strip()]
        for name in sorted(x for x in names if o.get("external_links") and x.endswith(".rels") and "/_rels/" in x):
            for r in ET.fromstring(z.read(name)):
                if r.get("Type") == HYPERLINK and r.get("TargetMode") == "External" and r.get("Target"):
                    rows.append(([text(r.get("Target"))], {"part": "relationships", "source_part_name": name, "source_relationship_id": r.get("Id", ""), "source_original": r.get("Target")}))
        if o.get("numbering_texts") and "word/numbering.xml" in names:
            rows += level_texts(ET.fromstring(z.read("word/numbering.xml")), ET.fromstring(z.read("word/document.xml")))
        wanted = [("word/document.xml", "body", None)]
        if o.get("include_headers_footers", True):
            wanted += [(x, "header" if "/header" in x else "footer", None) for x in sorted(names) if re.fullmatch(r"word/(header|footer)\d*\.xml", x)]
        wanted += [(f"word/{k}s.xml", k, k) for k in ("footnote", "endnote") if f"word/{k}s.xml" in names]
        if o.get("include_comments", True) and "word/comments.xml" in names:
            wanted.append(("word/comments.xml", "comment", "comment"))
        for name, kind, holder in wanted:
            root = ET.fromstring(z.read(name))
            part = Part(root, name, links(name), styles, rules, o.get("include_hidden", False))
            for el in root.findall(f"{W}{holder}") if holder else [root]:
                note = el.get(f"{W}id")
                if kind in ("footnote", "endnote") and note in ("-1", "0"):
                    continue
                rows += part.units(el, {"part": kind} | ({"comment_id" if kind == "comment" else "note_id": note} if holder else {}), o.get("attributes", False))
    for n, (parts, meta) in enumerate(rows, 1):
        yield unit(str(n), parts, meta)

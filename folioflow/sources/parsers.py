"""Document parsers: text or bytes in, event dictionaries out. No Spark here; one bad document raises."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from ..schema import DOCUMENT_PART, code, event, markup, text, unit

# Element names that decide how HTML is cut into units.
HTML_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "title", "dt", "dd", "caption"}
HTML_SKIPPED = {"script", "style", "noscript", "template"}
HTML_INLINE = {"b", "strong", "i", "em", "u", "code"}


def parse_txt(source: str, **_) -> Iterator[dict]:
    """The whole text is one unit; an empty text has none."""
    if source:
        yield unit("txt-1", [text(source)])


class _Html(HTMLParser):
    """Cuts a page into runs of block content; every tag inside a run stays as a part, so a run can be rebuilt."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.source, self.starts = source, [0]
        for line in source.split("\n")[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.found: list[dict] = []
        self.run: list[dict] = []
        self.at = 0
        self.blocks: list[str] = []
        self.hidden = 0

    def here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def cut(self, end: int) -> None:
        if any(p["ptype"] == "text" and p["text"].strip() for p in self.run):
            start = self.at
            where = {"html_element": self.blocks[-1]} if self.blocks else {}
            self.found.append(unit(str(len(self.found) + 1), self.run, where, (start, end)))
        self.run = []

    def add(self, p: dict) -> None:
        if not self.hidden:
            if not self.run:
                self.at = self.here()
            self.run.append(p)

    def handle_starttag(self, tag, attrs):
        if tag in HTML_SKIPPED:
            self.cut(self.here())
            self.hidden += 1
        elif tag in HTML_BLOCKS and not self.hidden:
            self.cut(self.here())
            self.blocks.append(tag)
        else:
            self.add(markup("start", tag, [(k, v or "") for k, v in attrs], self.get_starttag_text()))

    def handle_startendtag(self, tag, attrs):
        self.add(markup("empty", tag, [(k, v or "") for k, v in attrs], self.get_starttag_text()))

    def handle_endtag(self, tag):
        if tag in HTML_SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in HTML_BLOCKS and not self.hidden:
            self.cut(self.here())
            if tag in self.blocks:
                while self.blocks.pop() != tag:
                    pass
        elif not self.hidden:
            end = self.source.find(">", self.here())
            self.add(markup("end", tag, data=self.source[self.here() : end + 1 if end >= 0 else len(self.source)]))

    def handle_data(self, data):
        self.add(text(data))

    def handle_entityref(self, name):
        end = self.here() + len(name) + 1
        self.add(text(self.source[self.here() : end + (self.source[end : end + 1] == ";")]))

    def handle_charref(self, name):
        end = self.here() + len(name) + 2
        self.add(text(self.source[self.here() : end + (self.source[end : end + 1] == ";")]))

    def keep(self, name: str, closing: str) -> None:
        """Comments, instructions and declarations stay inside a run as they are written."""
        if self.run:
            end = self.source.find(closing, self.here())
            self.add(markup("empty", name, data=self.source[self.here() : end + len(closing) if end >= 0 else len(self.source)]))

    def handle_comment(self, data):
        start = self.here()
        self.keep("!--", "-->" if self.source.startswith("<!--", start) and self.source.startswith(data, start + 4) else ">")

    def handle_pi(self, data):
        self.keep("?", ">")

    def unknown_decl(self, data):
        self.keep("![", "]]>" if data.startswith("CDATA[") else ">")

    def handle_decl(self, decl):
        self.keep("!", ">")


def parse_html(source: str, **_) -> Iterator[dict]:
    """Block elements delimit units; hidden elements are skipped; blank units are dropped; spans cover the content."""
    p = _Html(source)
    p.feed(source)
    p.close()
    p.cut(len(source))
    yield from p.found


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<mark>[{}\[\],:])|(?P<scalar>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)|(?P<end>$))', re.S)
# What may come next in a container after what was there: a value ends a turn, a comma begins one.
_JSON_NEXT = {
    ("{", "open"): {"string", "}"}, ("{", "key"): {":"}, ("{", ":"): {"value"}, ("{", "value"): {",", "}"}, ("{", ","): {"string"},
    ("[", "open"): {"value", "]"}, ("[", "value"): {",", "]"}, ("[", ","): {"value"}, (None, "open"): {"value"}, (None, "value"): {"end"},
}


def json_values(source: str) -> Iterator[dict]:
    """Every string, number, boolean and null that is a value: text, whether it is a string, key, path, start, end (of the
    literal) and the numbers of its objects, outermost first. Anything that is no JSON raises an error."""
    boxes: list[dict] = [{"kind": None, "was": "open", "key": None, "count": -1, "step": None, "id": 0}]
    at = objects = 0
    while True:
        m, box = _JSON_TOKEN.match(source, at), boxes[-1]
        if not m:
            raise ValueError(f"JSON: unexpected text at {at}")
        at, allowed = m.end(), _JSON_NEXT[box["kind"], box["was"]]
        token = m["mark"] or ("string" if m["string"] else "scalar" if m["scalar"] else "end")
        is_key = token == "string" and "string" in allowed
        is_value = token in ("string", "scalar", "{", "[") and not is_key
        if not (is_key or token in allowed or (is_value and "value" in allowed)):
            raise ValueError(f"JSON: unexpected {token} at {m.start()}")
        if token == "end":
            return
        if is_key:
            box["key"], box["was"] = json.loads(m["string"], strict=False), "key"
        elif is_value:
            box["count"], box["was"] = box["count"] + 1, "value"
            step = box["key"] if box["kind"] == "{" else str(box["count"])
            if token in ("{", "["):
                objects += 1
                boxes.append({"kind": token, "was": "open", "key": None, "count": -1, "step": step if box["kind"] else None, "id": objects})
                continue
            name = "string" if m["string"] else "scalar"
            steps = [b["step"] for b in boxes if b["step"] is not None] + ([step] if box["kind"] else [])
            yield {
                "value": json.loads(m["string"], strict=False) if m["string"] else m["scalar"], "is_string": name == "string", "key": box["key"] if box["kind"] == "{" else None,
                "path": "/" + "/".join(steps), "start": m.start(name), "end": m.end(name), "objects": [b["id"] for b in boxes if b["kind"] == "{"],
            }
        elif token in ("}", "]"):
            boxes.pop()
        else:
            box["was"] = token


def split_codes(value: str, rules: list[str]) -> list[dict]:
    """Text and code parts: of overlapping matches the leftmost, then the shortest, wins."""
    found = sorted((m.start(), m.end()) for r in rules for m in re.finditer(r, value, re.M) if m.end() > m.start())
    out, at = [], 0
    for start, end in found:
        if start >= at:
            out += [text(value[at:start])] if start > at else []
            out.append(code(value[start:end], "regxph"))
            at = end
    return out + ([text(value[at:])] if at < len(value) or not out else [])


JSON_CODES = r"</?([A-Z0-9a-z]*)\b[^>]*>"  # fixed value: the rule where a code finder is asked for without one


def parse_json(source: str, **o) -> Iterator[dict]:
    """String values that the rules take, with names, notes, ids, generic metadata and width limits.

    Facts about an object (ids, notes, metadata, widths) may be numbers and booleans too, as they are written.
    A rule is a regular expression that has to match a whole key, or the whole path with useFullKeyPath;
    exceptions only have to be found in it. An extraction rule decides alone for the values that have a key;
    else extractAllPairs or extractStandalone decides and an exception turns the decision round.
    """
    full, lead = o.get("useFullKeyPath", False), o.get("useLeadingSlashOnKeyPath", True)
    spans = list(json_values(source))
    target = lambda s: s["path"] if full else s["key"] or ""
    hit = lambda rule, s: bool(rule) and re.fullmatch(rule, target(s)) is not None
    facts: dict[int, dict] = {}
    taken: set[int] = set()
    for n, s in enumerate(spans):
        for name, rule in (("id", "idRules"), ("note", "noteRules"), ("meta", "genericMetaRules"), ("width", "maxwidthRules")):
            if s["key"] is not None and s["objects"] and hit(o.get(rule), s):
                own = facts.setdefault(s["objects"][-1], {"note": [], "meta": {}})
                if name == "note":
                    own["note"].append({"from": s["key"], "text": s["value"]})
                elif name == "meta":
                    own["meta"][s["key"]] = s["value"]
                else:
                    own[name] = s["value"]
                taken.add(n)
    for n, s in enumerate(spans):
        if n in taken or not s["is_string"]:
            continue
        if s["key"] is not None and o.get("extractionRules"):
            wanted = hit(o["extractionRules"], s)
        else:
            wanted = o.get("extractAllPairs", True) if s["key"] is not None else o.get("extractStandalone", False)
            if o.get("exceptions") and re.search(o["exceptions"], target(s)):
                wanted = not wanted
        if not wanted:
            continue
        chain = [facts[i] for i in s["objects"] if i in facts]
        path = s["path"] if lead else s["path"].lstrip("/")
        ids = [c["id"] for c in chain if "id" in c]
        name = "/".join(ids) if ids and o.get("useIdStack") else ids[-1] if ids else (path if full else s["key"]) if o.get("useKeyAsName", True) else None
        meta = {"json_path": s["path"], "original": s["value"]} | ({"name": name} if name else {})
        if chain:
            near = chain[-1]
            meta |= {"notes": json.dumps(near["note"], ensure_ascii=False)} if near["note"] else {}
            meta |= {"generic_meta": json.dumps(near["meta"], ensure_ascii=False)} if near["meta"] else {}
            meta |= {"max_width": near["width"], "size_unit": o.get("maxwidthSizeUnit") or ""} if "width" in near else {}
        if o.get("subfilter") and (not o.get("subfilterRules") or hit(o["subfilterRules"], s)):
            yield event("START_SUBFILTER", f"sf{n + 1}", metadata=meta, span=(s["start"], s["end"]))
            for e in PARSERS[o["subfilter"]](s["value"]):
                yield e | {"unit_id": f"sf{n + 1}_{e['unit_id']}", "metadata": (e["metadata"] or {}) | {"parent_path": s["path"]}, "span_start": None, "span_end": None}
            yield event("END_SUBFILTER", f"sf{n + 1}")
            continue
        rules = o.get("codeFinderRules") or [JSON_CODES]
        rules = ([rules] if isinstance(rules, str) else rules) if o.get("useCodeFinder") else []
        yield unit(str(n + 1), split_codes(s["value"], rules), meta, (s["start"], s["end"]))


def parse_yaml(source: str, **_) -> Iterator[dict]:
    """One unit for each scalar value but nulls, in all documents; paths join keys and positions."""
    import yaml

    n, seen = 0, set()
    for root in yaml.compose_all(source, Loader=yaml.SafeLoader):
        todo = [(root, "")]
        while todo:
            node, path = todo.pop()
            if node is None or node.start_mark.index in seen and not isinstance(node, yaml.MappingNode | yaml.SequenceNode):
                continue  # an alias names a node that has its unit already
            if isinstance(node, yaml.ScalarNode):
                seen.add(node.start_mark.index)
            if isinstance(node, yaml.MappingNode):
                todo += [(v, f"{path}/{k.value}".lstrip("/")) for k, v in reversed(node.value)]
            elif isinstance(node, yaml.SequenceNode):
                todo += [(v, f"{path}/{i}".lstrip("/")) for i, v in reversed(list(enumerate(node.value)))]
            elif node.tag != "tag:yaml.org,2002:null":
                n += 1
                span = (node.start_mark.index, node.end_mark.index)
                if span[0] == span[1]:
                    continue
                yield unit(str(n), [text(node.value)], {"yaml_path": path, "original": node.value, "literal": source[span[0] : span[1]], "scalar_style": node.style or "plain"}, span)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def mixed(el: ET.Element) -> list[dict]:
    """Text and tags of mixed content in document order; an element without content is one empty tag."""
    out = [text(el.text)] if el.text else []
    for child in el:
        attributes = [(local(k), v) for k, v in child.attrib.items()]
        inner = mixed(child)
        out += [markup("start", local(child.tag), attributes), *inner, markup("end", local(child.tag))] if inner else [markup("empty", local(child.tag), attributes)]
        out += [text(child.tail)] if child.tail else []
    return out


def parse_xliff(source: str, **_) -> Iterator[dict]:
    """trans-units with a source in document order, with the languages of the file they stand in."""
    root = ET.fromstring(source)
    languages = {}
    for el in root.iter():
        if local(el.tag) == "file":
            languages = {"source_language": el.get("source-language", ""), "target_language": el.get("target-language", "")}
        if local(el.tag) != "trans-unit":
            continue
        sides = {local(c.tag): c for c in reversed(list(el)) if local(c.tag) in ("source", "target")}
        if "source" in sides:
            uid, target = el.get("id", ""), sides.get("target")
            parts = mixed(sides["source"])
            meta = {"part": "source", "trans_unit_id": uid, "source_original": "".join(sides["source"].itertext())} | languages
            yield unit(uid, parts, meta, target=None if target is None else mixed(target))


XLIFF2 = "urn:oasis:names:tc:xliff:document:2.0"  # fixed value


def parse_xliff2(source: str, **_) -> Iterator[dict]:
    root = ET.fromstring(source)
    if root.tag != f"{{{XLIFF2}}}xliff":
        raise ValueError("not XLIFF 2.0")
    for el in root.iter(f"{{{XLIFF2}}}unit"):
        segments = el.findall(f"{{{XLIFF2}}}segment")
        for k, seg in enumerate(segments):
            src, tgt = seg.find(f"{{{XLIFF2}}}source"), seg.find(f"{{{XLIFF2}}}target")
            if src is None:
                continue
            uid, sid = el.get("id", ""), seg.get("id")
            name = uid if len(segments) == 1 else f"{uid}:{sid or k}"
            meta = {"part": "source", "unit_id": uid, "segment_id": sid or "", "segment_index": str(k), "source_original": "".join(src.itertext())}
            yield unit(name, mixed(src), meta, target=None if tgt is None else mixed(tgt))


_MD_INLINE = re.compile(r"(?P<bold>\*\*[^*\n]+\*\*)|(?P<italic>\*[^*\n]+\*)|(?P<inline_code>`[^`\n]+`)|(?P<image>!\[[^\]]*\]\((?P<src>[^)]*)\))|(?P<link>\[[^\]]*\]\((?P<href>[^)]*)\))")


def md_inline(value: str) -> list[dict]:
    out, at = [], 0
    for m in _MD_INLINE.finditer(value):
        out += [text(value[at : m.start()])] if m.start() > at else []
        kind = next(k for k in ("bold", "italic", "inline_code", "image", "link") if m[k])
        out.append(code(m[0], kind, m["src"] if kind == "image" else m["href"] if kind == "link" else None))
        at = m.end()
    return out + ([text(value[at:])] if at < len(value) else [])


def parse_markdown(source: str, compat: bool = False, **_) -> Iterator[dict]:
    """Front matter and fences are kept apart; each other line is a unit with its inline codes.

    compat counts blank lines as units as well; else heading, list and quote marks and blank lines are document
    parts. Contents and parts in order give the source again either way.
    """
    n, fence, held = 0, None, []
    lines = source.splitlines(keepends=True)
    if lines and lines[0].rstrip("\r\n") == "---" and any(x.rstrip("\r\n") == "---" for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.rstrip("\r\n") == "---")
        yield event(DOCUMENT_PART, content="".join(lines[: end + 1]))
        lines = lines[end + 1 :]
    for line in lines:
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence is not None:
            if mark and mark[1].startswith(fence):
                n += 1
                if held:
                    yield unit(str(n), [code("".join(held), "protected")])
                yield event(DOCUMENT_PART, content=line)
                fence, held = None, []
            else:
                held.append(line)
        elif mark:
            fence = mark[1]
            yield event(DOCUMENT_PART, content=line)
        else:
            lead = "" if compat else re.match(r"\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s?)?", line)[0]
            body = line[len(lead) :]
            if not compat and (not body.strip() or re.fullmatch(r"\s*([-*_])(?:\s*\1){2,}\s*", line)):
                yield event(DOCUMENT_PART, content=line)
                continue
            n += 1
            if lead:
                yield event(DOCUMENT_PART, content=lead)
            end = "" if compat else body[len(body.rstrip("\r\n")) :]
            yield unit(str(n), md_inline(body[: len(body) - len(end)]))
            if end:
                yield event(DOCUMENT_PART, content=end)
    if held:
        yield unit(str(n + 1), [code("".join(held), "protected")])


def parse_lines(source: str, **_) -> Iterator[dict]:
    """Each line outside fences that is not blank and not indented by four is a unit; the rest is protected."""
    inside, n = False, 0
    for line in source.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            inside = not inside
            yield event(DOCUMENT_PART, content=line)
        elif inside or not line.strip() or line.startswith("    "):
            yield event(DOCUMENT_PART, content=line)
        else:
            n += 1
            yield unit(f"line-{n}", md_inline(line))


def parse_epub(source: bytes, **_) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        for name in z.namelist():
            if name.lower().endswith((".xhtml", ".html", ".htm")):
                for e in parse_html(z.read(name).decode("utf-8")):
                    yield e | {"metadata": e["metadata"] | {"epub_path": name}}


def _word(source: bytes, **o) -> Iterator[dict]:
    from .word import parse_docx

    return parse_docx(source, **o)


# Markers of the token types that pairs are made of.
MARKERS = {"STRONG_EMPHASIS": ("**", "bold"), "EMPHASIS": ("*", "italic"), "CODE": ("`", "inline_code")}


def parse_tokens(source: str, rules=tuple(MARKERS), **_) -> Iterator[dict]:
    """One unit, its paired markers as codes; ``rules``: token types, an earlier one goes first where several fit.

    What stands between two equal markers is text. A marker without a partner is text too.
    """
    kinds = dict(MARKERS[r] for r in rules if r in MARKERS)
    parts, at = [], 0
    for m in re.finditer(f"({'|'.join(map(re.escape, kinds))})(?:(.*?)\\1)?", source, re.DOTALL) if kinds else ():
        if m[2] is not None:
            mark = code(m[1], kinds[m[1]])
            parts += [p for p in (text(source[at : m.start()]), mark, text(m[2]), mark) if p["text"] != ""]
            at = m.end()
    if at < len(source) or not parts:
        parts.append(text(source[at:]))
    yield unit("generated-1", parts, {}, (0, len(source)))


PARSERS = {
    "txt": parse_txt, "html": parse_html, "json": parse_json, "yaml": parse_yaml, "xliff": parse_xliff, "xliff2": parse_xliff2,
    "epub": parse_epub, "markdown": parse_markdown, "lines": parse_lines, "docx": _word, "tokens": parse_tokens,
}
BINARY = {"epub", "docx"}

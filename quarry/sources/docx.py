"""Word documents to blocks, from the zip's XML."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from quarry.sources.markup import Parsed, ParseError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
MAX_PART, MAX_NODES, MAX_DEPTH, MAX_BASED_ON = 192 << 20, 8_000_000, 256, 16


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        if z.getinfo(name).file_size > MAX_PART:
            raise ParseError("a part of the document is too large")
        data = z.read(name)
    except KeyError:
        return None
    root, depth, nodes, deepest = None, 0, 0, 0
    for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
        depth += 1 if event == "start" else -1
        nodes, deepest = nodes + (event == "start"), max(deepest, depth)
        if deepest > MAX_DEPTH or nodes > MAX_NODES:
            raise ParseError("the document is too deep or has too many nodes")
        root = e if root is None else root
    return root


def _val(e: ET.Element | None, path: str) -> str | None:
    got = None if e is None else e.find("/".join(_W + p for p in path.split("/")))
    return None if got is None else got.get(_W + "val", "")


def _level_of(name: str | None, outline: str | None) -> int | None:
    if name:
        if got := re.fullmatch(r"heading\s*([1-9])", name.strip().lower()):
            return int(got[1])
        if name.strip().lower() == "title":
            return 1
    if outline is not None and outline.isdigit():
        return int(outline) + 1 if int(outline) < 9 else 0
    return None


def _styles(root: ET.Element | None) -> dict[str, tuple[int, bool]]:
    """(heading level or 0, list item) of each style, over what it is based on."""
    raw = {}
    for s in [] if root is None else root.iter(_W + "style"):
        p = s.find(_W + "pPr")
        num = _val(p, "numPr/numId")
        raw[s.get(_W + "styleId")] = (_level_of(_val(s, "name"), _val(p, "outlineLvl")), None if num is None else num != "0", _val(s, "basedOn"))
    out = {}
    for key in raw:
        level = item = None
        at, steps = key, 0
        while at in raw and steps <= MAX_BASED_ON and (level is None or item is None):
            own_level, own_item, base = raw[at]
            level, item = own_level if level is None else level, own_item if item is None else item
            at, steps = base, steps + 1
        out[key] = (level or 0, bool(item))
    return out


def _text(e: ET.Element, boxes: list[ET.Element]) -> str:
    """Text of a paragraph without what was deleted; its text boxes go to ``boxes``."""
    out = []
    for c in e:
        if c.tag in (_W + "del", _W + "moveFrom", _MC + "Fallback", _W + "pPr"):
            continue
        if c.tag == _W + "t":
            out.append(c.text or "")
        elif c.tag in (_W + "tab", _W + "br", _W + "cr"):
            out.append(" ")
        elif c.tag == _W + "noBreakHyphen":
            out.append("-")
        elif c.tag == _W + "txbxContent":
            boxes.append(c)
        else:
            out.append(_text(c, boxes))
    return "".join(out)


def parse_docx(data: bytes) -> Parsed:
    done = Parsed()
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = _part(z, "word/document.xml")
            try:
                styles = _styles(_part(z, "word/styles.xml"))
            except ET.ParseError:
                styles = {}
                done.warnings.append("styles_unreadable")
    except (zipfile.BadZipFile, ET.ParseError) as bad:
        raise ParseError("the file is not a readable Word document") from bad
    body = None if body is None else body.find(_W + "body")
    if body is None:
        raise ParseError("the file has no document part")

    def paragraph(p: ET.Element) -> None:
        boxes: list[ET.Element] = []
        text = " ".join(_text(p, boxes).split())
        props = p.find(_W + "pPr")
        level, item = styles.get(_val(props, "pStyle") or "", (0, False))
        direct = _level_of(None, _val(props, "outlineLvl"))
        level = level if direct is None else direct
        number = _val(props, "numPr/numId")
        item = item if number is None else number != "0"
        if text:
            done.blocks.append(("heading", level, text) if level else ("list_item" if item else "paragraph", None, text))
            if level == 1 and done.title is None:
                done.title = text
        for box in boxes:
            walk(box)

    def table(t: ET.Element) -> None:
        rows = []
        for row in t.iter(_W + "tr"):
            cells = [" ".join(" ".join(_text(p, []) for p in cell.iter(_W + "p")).split()).replace("|", "\\|") for cell in row.findall(_W + "tc")]
            if any(cells):
                rows.append(" | ".join(cells))
        if rows:
            done.blocks.append(("table", None, "\n".join(rows)))

    def walk(e: ET.Element) -> None:
        for c in e:
            if c.tag == _W + "p":
                paragraph(c)
            elif c.tag == _W + "tbl":
                table(c)
            elif c.tag not in (_W + "del", _W + "moveFrom", _MC + "Fallback"):
                walk(c)

    walk(body)
    return done

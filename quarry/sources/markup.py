"""Parsers: bytes and text to blocks.

A block is (kind, level, text) with kind heading, paragraph, list_item, code or
table. Each parser is a function of one document; ``parsed`` applies them in
Arrow batches as a column.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.sources.outline import Outline

BLOCK_SCHEMA = "struct<kind:string,level:int,text:string>"
PARSED_SCHEMA = f"title string, blocks array<{BLOCK_SCHEMA}>, warnings array<string>, pages array<int>, error string"


class ParseError(ValueError):
    """A document that cannot be read, with a message for its owner."""


@dataclass
class Parsed:
    title: str | None = None
    blocks: list[tuple[str, int | None, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    pages: list[int | None] = field(default_factory=list)

    def page_of(self, i: int) -> int | None:
        return self.pages[i] if len(self.pages) == len(self.blocks) else None


def decode_utf8(data: bytes) -> str:
    """Text without its byte order mark; UTF-16, broken UTF-8 and NUL are refused."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ParseError("the file is UTF-16; save it as UTF-8")
    skip = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    try:
        text = data[skip:].decode()
    except UnicodeDecodeError as bad:
        raise ParseError(f"the file is not valid UTF-8 at byte {bad.start + skip}") from bad
    if "\0" in text:
        raise ParseError("the file holds NUL characters; it is not text")
    return text


def paragraph_blocks(text: str) -> list[tuple[str, int | None, str]]:
    """Paragraphs between blank lines, and heading lines."""
    blocks: list[tuple[str, int | None, str]] = []
    held: list[str] = []
    outline = Outline()

    def close() -> None:
        if held:
            blocks.append(("paragraph", None, " ".join(" ".join(held).split())))
            held.clear()

    for line in re.split(r"\r\n|\n|\r", text):
        got = outline.line(line)
        if got == "body":
            held.append(line.strip())
        elif isinstance(got, str):
            if blocks and blocks[-1][0] == "heading":
                kind, level, before = blocks[-1]
                blocks[-1] = (kind, level, before + got[1:])
        else:
            close()
            if got:
                blocks.append(("heading", *got))
    close()
    return blocks


def parse_plain(text: str) -> Parsed:
    return Parsed(blocks=paragraph_blocks(text))


# --- HTML -------------------------------------------------------------------

#: Inline tags that part the words around them.
WORD_BREAKS = frozenset("br hr img p div li td th tr table ul ol h1 h2 h3 h4 h5 h6 blockquote pre".split())
_TAG = re.compile(r"""<[A-Za-z/!?](?:[^<>"']|"[^"]*"|'[^']*')*>""")
_NAME = re.compile(r"[</]+([A-Za-z0-9]*)")


def _tag_name(tag: str) -> str:
    got = _NAME.match(tag)
    return got[1].lower() if got else ""


def html_to_text(source: str) -> str:
    """Visible text: each tag a space, comments and script and style bodies gone,
    entities decoded; a ``<`` that opens no complete tag is text."""
    out, at = [], 0
    while (lt := source.find("<", at)) >= 0:
        out.append(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt)
            at = len(source) if end < 0 else end + 3
            out.append(" ")
            continue
        tag = _TAG.match(source, lt)
        if tag is None:
            out.append("<")
            at = lt + 1
            continue
        at = tag.end()
        name = _tag_name(tag[0])
        if name in ("script", "style") and source[lt + 1] != "/":
            closing = re.compile(rf"</+{name}(?![A-Za-z0-9])[^>]*>", re.IGNORECASE).search(source, lt)
            at = closing.end() if closing else len(source)
        out.append(" ")
    out.append(source[at:])
    return html.unescape("".join(out))


def _inline(text: str) -> str:
    """Text of a line of Markdown: marks of emphasis, links, images and code gone,
    their words kept; break tags are spaces, other tags nothing."""
    held: list[str] = []

    def keep(value: str) -> str:
        held.append(value)
        return f"\x00{len(held) - 1}\x00"

    x = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    x = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2].strip() if m[2].strip() else m[2]), x)
    x = _TAG.sub(lambda m: " " if _tag_name(m[0]) in WORD_BREAKS else "" if not re.match(r"<[a-z]+:", m[0]) else keep(m[0][1:-1]), x)
    x = re.sub(r"!?\[([^\[\]]*)\]\((?:[^()]|\([^()]*\))*\)", r"\1", x)
    x = re.sub(r"(\*\*\*|\*\*|\*)(?=\S)(.+?)(?<=\S)\1", r"\2", x)
    x = re.sub(r"(?<!\w)(___|__|_)(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", x)
    x = html.unescape(x)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], x)


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:[A-Za-z/][A-Za-z0-9-]*[\s/>]|!--|[?!])")


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [" ".join(_inline(c.replace("\\|", "|")).split()).replace("|", "\\|") for c in re.split(r"(?<!\\)\|", row)]


class _Markdown:
    """Block structure by lines; quotes and items recurse into their own lines."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int | None, str]] = []
        self.title: str | None = None

    def _add(self, kind: str, text: str, level: int | None = None) -> None:
        if text:
            self.blocks.append((kind, level, text))

    def read(self, lines: list[str], kind: str = "paragraph", top: bool = True) -> None:
        held: list[str] = []

        def close() -> None:
            joined = " ".join(" ".join(_inline("\n".join(s.strip() for s in held)).split("\n")).split())
            self._add(kind, joined)
            held.clear()

        def heading(level: int, text: str) -> None:
            text = " ".join(_inline(text).split())
            if level == 1 and top and self.title is None and text:
                self.title = text
            self._add("heading", text, level)

        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                close()
                i += 1
                continue
            if (line.startswith(("    ", "\t"))) and not held:
                j = i
                while j < len(lines) and (not lines[j].strip() or lines[j].startswith(("    ", "\t"))):
                    j += 1
                code = [s[1:] if s.startswith("\t") else s[4:] for s in lines[i:j]]
                self._add("code", "\n".join(code).rstrip().lstrip("\n"))
                i = j
            elif fence := _FENCE.match(line):
                close()
                indent = len(line) - len(line.lstrip(" "))
                end = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
                j = i + 1
                while j < len(lines) and not end.match(lines[j]):
                    j += 1
                self._add("code", "\n".join(re.sub(rf"^ {{0,{indent}}}", "", s) for s in lines[i + 1 : j]).rstrip().lstrip("\n"))
                i = j + 1
            elif got := _HEADING.match(line):
                close()
                heading(len(got[1]), got[2] or "")
                i += 1
            elif held and (got := _UNDERLINE.match(line)):
                text = "\n".join(held)
                held.clear()
                heading(1 if got[1][0] == "=" else 2, text)
                i += 1
            elif _RULE.match(line):
                close()
                i += 1
            elif line.lstrip().startswith(">"):
                close()
                j = i
                while j < len(lines) and lines[j].strip() and (lines[j].lstrip().startswith(">") or j > i):
                    j += 1
                self.read([re.sub(r"^ {0,3}> ?", "", s) for s in lines[i:j]], kind, False)
                i = j
            elif (got := _ITEM.match(line)) and not (held and not got[4]) and not (held and got[2][:-1].isdigit() and got[2][:-1] != "1"):
                close()
                width = len(got[1]) + len(got[2]) + (len(got[3]) if got[3] and len(got[3]) <= 4 else 1)
                own = [line[width:] if got[4] else ""]
                j = i + 1
                while j < len(lines):
                    inner = lines[j]
                    if inner.strip() and len(inner) - len(inner.lstrip(" ")) < width and (_ITEM.match(inner) or own[-1].strip() == "" or _HEADING.match(inner) or _FENCE.match(inner)):
                        break
                    own.append(inner[min(width, len(inner) - len(inner.lstrip(" "))) :])
                    j += 1
                self.read(own, "list_item", False)
                i = j
            elif "|" in line and i + 1 < len(lines) and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                close()
                j = i + 2
                while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                    j += 1
                wide = len(_cells(line))
                rows = [(_cells(s) + [""] * wide)[:wide] for s in [line, *lines[i + 2 : j]]]
                self._add("table", "\n".join(" | ".join(r) for r in rows if any(r)))
                i = j
            elif _HTML_BLOCK.match(line) and not held:
                j = i
                while j < len(lines) and lines[j].strip():
                    j += 1
                self._add(kind, " ".join(html_to_text("\n".join(lines[i:j])).split()))
                i = j
            else:
                held.append(line)
                i += 1
        close()


def parse_markdown(text: str) -> Parsed:
    reader = _Markdown()
    reader.read(re.split(r"\r\n|\n|\r", text))
    return Parsed(title=reader.title, blocks=reader.blocks)


def demote_running_headers(blocks: list[tuple[str, int | None, str]], pages: list[int | None], least: int = 3) -> list[tuple[str, int | None, str]]:
    """Headings that stand on ``least`` pages and half of the pages become paragraphs."""
    on: dict[str, set] = {}
    for (kind, _, text), page in zip(blocks, pages):
        if kind == "heading":
            on.setdefault(text, set()).add(page)
    half = len(set(pages))
    running = {t for t, p in on.items() if len(p) >= least and 2 * len(p) >= half}
    return [("paragraph", None, t) if k == "heading" and t in running else (k, level, t) for k, level, t in blocks]


def parse_pages(texts: list[str]) -> Parsed:
    """Blocks of a document given as the text of its pages, with each block's page."""
    blocks, pages = [], []
    for number, text in enumerate(texts, 1):
        found = paragraph_blocks(join_hyphenated(text))
        blocks += found
        pages += [number] * len(found)
    issues = [page_issue(t) for t in texts]
    warnings = ["ocr_required"] if any(not t.strip() for t in texts) else []
    for issue in dict.fromkeys(i for i in issues if i):
        warnings.append(f"{issue} on pages {page_list([n for n, i in enumerate(issues, 1) if i == issue])}")
    return Parsed(blocks=demote_running_headers(blocks, pages), pages=pages, warnings=warnings)


def page_issue(text: str) -> str | None:
    """Why a page's text looks garbled, as ``functions.text.suspicious`` says it of a column."""
    words = text.split()
    visible = sum(map(len, words))
    if visible < 200:
        return None
    unmapped = sum(c == "\ufffd" or unicodedata.category(c) == "Cc" for w in words for c in w)
    if unmapped * 1000 >= visible * 10:
        return "unmapped characters"
    single = "".join("1" if len(w) == 1 and unicodedata.category(w)[0] == "L" else "0" for w in words)
    split = sum(len(run) for run in single.split("0") if len(run) >= 4)
    return "words split into single letters" if split * 100 >= len(words) * 40 else None


def join_hyphenated(text: str) -> str:
    """Words broken at a line's end joined; a real hyphen after one letter stays."""
    lower = r"(?=[^\W\d_])(?=(.))"
    pattern = re.compile("(?P<before>[^\\W\\d_]?)(?P<letter>[^\\W\\d_])(?P<mark>[-\xad])\r?\n" + lower, re.DOTALL)

    def glue(m: re.Match) -> str:
        if not m[m.lastindex].islower():
            return m[0]
        keep = "-" if m["mark"] == "-" and not m["before"] else ""
        return m["before"] + m["letter"] + keep

    return pattern.sub(glue, text)


def page_list(pages: list[int]) -> str:
    """``1-3, 5``: runs of consecutive numbers."""
    runs: list[list[int]] = []
    for p in pages:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)


def parse(data: bytes, kind: str) -> Parsed:
    """A document of a detected format (``formats.detect``)."""
    if kind == "docx":
        from quarry.sources.docx import parse_docx

        return parse_docx(data)
    if kind == "pdf":
        raise ParseError("no PDF extractor: give the text of the pages to parse_pages")
    return (parse_markdown if kind == "md" else parse_plain)(decode_utf8(data))


def _parsed(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for data, k in zip(content, kind):
        try:
            p = parse(bytes(data or b""), k)
            rows.append((p.title, [dict(zip(("kind", "level", "text"), b)) for b in p.blocks], p.warnings, p.pages, None))
        except ParseError as bad:
            rows.append((None, [], [], [], str(bad)))
    return pd.DataFrame(rows, columns=["title", "blocks", "warnings", "pages", "error"])


def parsed(content: str | Column, kind: str | Column) -> Column:
    """Blocks of binary documents; what cannot be read has ``error``."""
    return F.pandas_udf(_parsed, PARSED_SCHEMA)(content, kind)

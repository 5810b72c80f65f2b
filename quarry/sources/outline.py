"""Heading lines in text without markup, read line by line.

A line that looks like a title is one: short, not ending as a sentence does, and
in capitals, framed by dashes, or numbered by a Roman numeral or a letter. What
came before decides the rest, so a document is folded in order; documents are
independent of one another and run in parallel.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Limits and word lists of the heading rules.
MAX_CHARS, MAX_WORDS, MIN_LETTERS, MAX_NAME_WORDS = 80, 12, 4, 8
PART_WORDS = ("KISIM", "PART")
CHAPTER_WORDS = ("BÖLÜM", "CHAPTER", "SECTION")
ORDINAL_LAST = ("KISIM", "BÖLÜM")
ADMONITIONS = frozenset(("UYARI", "DİKKAT", "ÖNEMLİ", "TEHLİKE", "WARNING", "CAUTION", "NOTE", "IMPORTANT", "DANGER"))
SENTENCE_END = tuple(".,;:!?")
LEVELS = {"part": 1, "chapter": 2, "capitals": 3, "dashed": 4, "roman": 5, "letter": 6}
_LETTER_AFTER = {("H", "I"), ("U", "V"), ("Ü", "V"), ("W", "X")}
# End of the fixed values.

_ROMAN = re.compile(r"[IVXLC]{1,6}")


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def clean(text: str) -> str:
    """White space collapsed and a footnote number glued to the last word dropped."""
    words = text.split()
    if words:
        stem = words[-1].rstrip("0123456789")
        if stem != words[-1] and letters(stem) >= MIN_LETTERS and stem[-1:].isalpha():
            words[-1] = stem
    return " ".join(words)


def _tabular(line: str) -> bool:
    return "\t" in line or " | " in line or line.count("   ") >= 2


def _is_upper(ch: str) -> bool:
    return unicodedata.category(ch) == "Lu"


def _capitals_kind(line: str) -> str | None:
    """part, chapter or capitals, for a line without a lower-case letter."""
    if letters(line) < MIN_LETTERS or any(map(str.islower, line)):
        return None
    bare = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in line.split()) if w]
    if len(bare) == 1 and bare[0] in ADMONITIONS:
        return None
    for kind, names in (("part", PART_WORDS), ("chapter", CHAPTER_WORDS)):
        led = len(bare) > 1 and bare[0] in names and (bare[1][0] in "0123456789" or _ROMAN.fullmatch(bare[1]))
        ended = len(bare) > 1 and bare[-1] in names and bare[-1] in ORDINAL_LAST
        if led or ended:
            return kind
    return "capitals"


def _numbered_kind(line: str, last_letter: str | None) -> str | None:
    marker, _, title = re.sub(r"\s", " ", line, count=1).partition(" ")
    title = title.lstrip()
    if not title or not _is_upper(title[0]) or letters(title) < 2 or not marker.endswith("."):
        return None
    body = marker[:-1]
    single = len(body) == 1 and _is_upper(body)
    continues = single and (last_letter, body) in _LETTER_AFTER
    if _ROMAN.fullmatch(body) and not continues and (len(body) > 1 or body in "IVX"):
        return "roman"
    return "letter" if single else None


@dataclass
class Outline:
    """Reads one text's lines in order. ``line`` gives None for a blank line, "body",
    (level, text) for a heading, or a string that lengthens the heading before."""

    complete: bool = True
    last_letter: str | None = None
    open: str | None = None

    def _kind(self, line: str) -> str | None:
        if len(line.split()) > MAX_WORDS or len(line) > MAX_CHARS or _tabular(line) or line.endswith(SENTENCE_END):
            return None
        if len(line) >= 4 and line.startswith("--") and line.endswith("--") and letters(line) >= MIN_LETTERS:
            return "dashed"
        return _capitals_kind(line) or (_numbered_kind(line, self.last_letter) if self.complete else None)

    def line(self, raw: str):
        line = raw.strip()
        if not line:
            return None
        kind = self._kind(line)
        if kind is None:
            return self._plain(line)
        text = clean(line[2:-2].strip() if kind == "dashed" else line)
        if kind == "capitals" and self.open in ("part", "chapter"):
            self.open = None
            return f"+ - {text}"
        if kind == "capitals" and self.open == "capitals":
            return f"+ {text}"
        self.complete, self.open = True, kind
        if kind in ("letter", "roman"):
            self.last_letter = line[0] if kind == "letter" else None
        return LEVELS[kind], text

    def _plain(self, line: str):
        named = self.open in ("part", "chapter") and len(line.split()) <= MAX_NAME_WORDS and _is_upper(line[0]) and letters(line) >= 3
        self.open = None
        if named and not line.endswith(SENTENCE_END) and not _tabular(line):
            return f"+ - {line}"
        if letters(line):
            self.complete = line.endswith((*SENTENCE_END, ")"))
        return "body"

"""Exact lexical normalization, for any Unicode text.

Decomposition and composition are not SQL functions, so they run as a pandas UDF,
but only on texts that need them: ``plain`` are the characters for which the SQL
form ``text.fold`` is proved equal one by one (each is a starter that composes
with nothing beside it), and a text of such characters alone stays in the JVM.
Python's Unicode tables are those of its version."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as plain_text

# Code points ignored by default, and private use.
_IGNORED_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: The first as a character class of Spark's patterns.
IGNORED_CLASS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _IGNORED_RANGES) + "]"
_PRIVATE_RANGES = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
_any = lambda ranges: re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")
_IGNORED, _PRIVATE = _any(_IGNORED_RANGES), _any(_PRIVATE_RANGES)
_I_FORMS = frozenset("i\u0131I\u0130")
_HATTED = _I_FORMS | frozenset("aAuU")
_DOT_OR_HAT = re.compile("[\u0307\u0302]")
_RUNS = re.compile(r"([\x00-\x7f]?[^\x00-\x7f]+)")


def _without_marks(text: str) -> str:
    """Without the dot above among the marks of an i and the circumflex among
    those of an a, i or u; ``text`` is decomposed."""
    out, done, last, base = [], 0, -1, ""
    for found in _DOT_OR_HAT.finditer(text):
        at = before = found.start()
        # back to what the marks stand on, or to the mark before whose base is known
        while before > 0 and before - 1 != last and unicodedata.category(text[before - 1])[0] == "M":
            before -= 1
        if before - 1 != last or before == 0:
            base = text[before - 1] if before else ""
        last = at
        if base in _I_FORMS if text[at] == "\u0307" else base in _HATTED:
            out.append(text[done:at])
            done = at + 1
    return "".join(out) + text[done:]


def _normal(text: str) -> str:
    x = _IGNORED.sub("", unicodedata.normalize("NFKD", text))
    x = _without_marks(x).replace("\u0130", "i").replace("I", "i").replace("\u0131", "i")
    x = _PRIVATE.sub(" ", x)
    # no letter's lower case depends on its neighbours: those of a sigma would, so then it is one character at a time
    x = "".join(map(str.lower, x)) if "\u03a3" in x else x.lower()
    return unicodedata.normalize("NFC", x.replace("ß", "ss"))


_remembered = lru_cache(1 << 16)(_normal)


def _run(text: str) -> str:
    return _remembered(text) if len(text) <= 8 else _normal(text)


def normalize_for_lexical(text: str) -> str:
    """Compatibility-decomposed, invisible characters out, i forms and the Turkish
    circumflex folded, lower case, recomposed. An ASCII character composes with none before it, so what is to be
    done is done run by run of others, each with the character that its marks may stand on; runs recur."""
    if text.isascii():
        return text.lower()
    parts = _RUNS.split(text)
    parts[::2] = map(str.lower, parts[::2])
    parts[1::2] = map(_run, parts[1::2])
    return "".join(parts)


def _folds(ch: str) -> bool:
    """Whether ``text.fold`` does for this character, whatever stands beside it."""
    folded = ch.lower().replace("i\u0307", "i")
    for before, after in plain_text.FOLDED:
        folded = folded.replace(before, after)
    alone = unicodedata.category(ch)[0] not in "MC" and unicodedata.combining(ch) == 0 and unicodedata.is_normalized("NFC", ch)
    # a final sigma is lowered by what is beside it; white space is not always kept as it is
    return (alone or ch in "\t\n\r") and ch != "\u03a3" and normalize_for_lexical(ch) == folded


def _ranges(chars: list[int]) -> str:
    """A character class of sorted code points."""
    out, start = [], None
    for c, following in zip(chars, [*chars[1:], -1]):
        start = c if start is None else start
        if following != c + 1:
            out.append(rf"\x{{{start:X}}}-\x{{{c:X}}}")
            start = None
    return "".join(out)


def plain(texts: str | Column) -> Column:
    """Whether a text consists of characters that ``text.fold`` normalizes exactly. Letters
    beyond the European scripts go the exact way. A class of many ranges is looked through range by
    range for every character, so runs of the commonest are taken out first."""
    x = F.col(texts) if isinstance(texts, str) else texts
    known = [c for c in (*range(0x500), *range(0x2000, 0x2C00)) if _folds(chr(c))]
    common = [c for c in known if c < 0x80 or 0xBF <= c < 0x100]
    return F.regexp_replace(x, f"[{_ranges(common)}]+", "").rlike(f"^[{_ranges(known)}]*\\z")


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_for_lexical, na_action="ignore")


def normalized(texts: str | Column) -> Column:
    """Texts in the form that the term index holds; only those that need it pass through Python."""
    x = F.col(texts) if isinstance(texts, str) else texts
    exact = F.pandas_udf(_normalized, "string")(F.when(~plain(x), x))
    return F.coalesce(exact, plain_text.fold(x))


def _terms_of(texts: pd.Series) -> pd.Series:
    return texts.map(lexical_terms, na_action="ignore")


def query_terms(texts: str | Column) -> Column:
    """``lexical_terms`` of each text: questions are few, so all go the exact way."""
    return F.pandas_udf(_terms_of, "array<string>")(F.col(texts) if isinstance(texts, str) else texts)


def is_term_char(ch: str) -> bool:
    return not "\U0001f100" <= ch <= "\U0001f1ff" and (ch.isalnum() or unicodedata.category(ch)[0] in "NM" or ch.isalpha())


def words(normal: str) -> list[str]:
    """Runs of term characters that hold a letter or number."""
    spaced = "".join(c if is_term_char(c) else " " for c in normal)
    return [w for w in spaced.split(" ") if any(c.isalnum() or unicodedata.category(c)[0] == "N" for c in w)]


def lexical_terms(text: str, most: int = 32, chars: int = 4096) -> list[str]:
    """Distinct terms in first-seen order; one cut by the length cap is dropped."""
    head, rest = text[:chars], text[chars:]
    normal = normalize_for_lexical(head)
    if rest and normal and is_term_char(normal[-1]):
        following = normalize_for_lexical(_IGNORED.sub("", rest[:64])[:8])
        if following and is_term_char(following[0]):
            while normal and is_term_char(normal[-1]):
                normal = normal[:-1]
    return list(dict.fromkeys(words(normal)))[:most]

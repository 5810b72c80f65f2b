"""Citations, abstentions and facts in generated answers.

Each is a function of one text; the columns at the end apply them in Arrow
batches. ``cited_numbers`` is the SQL form for answers without fenced code.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.normalize import lexical_terms, normalize_for_lexical

# Sentences, phrases and word lists that answers are held against.
REFUSAL_EN, REFUSAL_TR = "I could not find this in the documents.", "Bu bilgi belgelerde bulunamadı."
TURKISH_MARKERS = frozenset(("nedir", "nasil", "kac", "hangi", "neden", "nerede", "midir", "icin"))
TURKISH_LETTERS = "ğışİĞŞ"
NOT_FOUND = (
    "belirtilmemi", "bulunmamaktadir", "bulunmuyor", "bulunamadi", "yer almamaktadir", "yer almiyor", "içermemektedir", "içermiyor", "bilgi yok", "değinilmemi",
    "not mentioned", "do not mention", "does not mention", "no information", "not specified", "not stated", "not explicitly", "do not explicitly",
    "does not explicitly", "do not contain", "does not contain", "could not find",
)
SOURCE_WORDS = ("kaynak", "belge", "metin", "source", "document", "context")
CONTRASTS = (" but ", " however", " ancak ", " ama ", " fakat ", " yalnız ")
UNITS = {"tr": ("bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"), "en": ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")}
TENS = {
    "tr": ("on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"),
    "en": ("ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"),
}
SCALES = {"tr": ("yüz", "bin", "milyon"), "en": ("hundred", "thousand", "million")}
MAX_RANGE = 64
# End of the fixed values.

_PART = re.compile(r"\s*\^*\s*(0|[1-9]\d{0,2})\s*(?:[-–—−]\s*(0|[1-9]\d{0,2})\s*)?\\*\s*", re.ASCII)
_FENCE = re.compile(r"[>\s]*(`{3,}|~{3,})([^\r\n]*)\r?\n?$")


def prose_spans(answer: str) -> list[tuple[int, int]]:
    """What lies outside fenced code that is closed, as spans."""
    lines, at = [], 0
    for line in answer.splitlines(keepends=True) if "\r" not in answer else re.findall(r"[^\n]*\n|[^\n]+$", answer):
        lines.append((at, at + len(line), _FENCE.fullmatch(line)))
        at += len(line)
    # where closers of each mark are, from the end, the longest on top of a falling stack
    below: dict[str, list[tuple[int, int]]] = {"`": [], "~": []}
    closes: list[int | None] = [None] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        fence = lines[i][2]
        if not fence:
            continue
        mark, run, info = fence[1][0], len(fence[1]), fence[2]
        if not (mark == "`" and "`" in info):
            closes[i] = next((j for j, r in reversed(below[mark]) if r >= run), None)
        if not info.strip():
            while below[mark] and below[mark][-1][1] <= run:
                below[mark].pop()
            below[mark].append((i, run))
    spans, begin, i = [], 0, 0
    while i < len(lines):
        if closes[i] is None:
            i += 1
            continue
        spans.append((begin, lines[i][0]))
        begin, i = lines[closes[i]][1], closes[i] + 1
    return spans + [(begin, len(answer))]


def _numbers(inside: str) -> list[int] | None:
    out: list[int] = []
    for part in inside.split(","):
        got = _PART.fullmatch(part)
        if not got:
            return None
        low, high = int(got[1]), int(got[2] or got[1])
        if not low <= high <= low + MAX_RANGE:
            return None
        out += range(low, high + 1)
    return out


def extract_citations(answer: str, sources: int) -> dict:
    """Numbers cited that exist and that do not, each once in first-seen order,
    and every marker with its byte offsets."""
    markers, seen = [], {}
    for a, b in prose_spans(answer):
        for m in re.finditer(r"\[([^\[\]]*)\]", answer[a:b]):
            numbers = _numbers(m[1])
            if numbers is None:
                continue
            first = len(answer[: a + m.start()].encode())
            markers.append({"start": first, "end": first + len(m[0].encode()), "numbers": numbers})
            seen.update(dict.fromkeys(numbers))
    return {"valid": [n for n in seen if 1 <= n <= sources], "invalid": [n for n in seen if not 1 <= n <= sources], "markers": markers}


def refusal_for(question: str) -> str:
    turkish = any(c in TURKISH_LETTERS for c in question) or not TURKISH_MARKERS.isdisjoint(lexical_terms(question))
    return REFUSAL_TR if turkish else REFUSAL_EN


def _core(text: str) -> str:
    normal = normalize_for_lexical(text)
    inside = [i for i, c in enumerate(normal) if c.isalnum()]
    return normal[inside[0] : inside[-1] + 1] if inside else ""


def is_refusal(answer: str) -> bool:
    return _core(answer) in (_core(REFUSAL_EN), _core(REFUSAL_TR))


_SENTENCE_END = re.compile(r"\n|(?:(?<![0-9])\.|[!?])(?=\s|$)")


def first_sentence(text: str) -> str:
    """Up to the first sentence end or line end; a citation right after belongs to it."""
    text = text.lstrip()
    end = _SENTENCE_END.search(text)
    if not end:
        return text
    cited = re.compile(r"[ \t]*\[[^\]]*\]?").match(text, end.end())
    return text[: cited.end()] if cited else text[: end.start()]


def abstained(answer: str) -> bool:
    """A refusal, or a first sentence without citation that says, before any
    contrast, that the sources do not tell."""
    if is_refusal(answer):
        return True
    first = normalize_for_lexical(first_sentence(answer))
    if "[" in first or not any(w in first for w in SOURCE_WORDS):
        return False
    head = first[: min((k for k in map(first.find, CONTRASTS) if k >= 0), default=len(first))]
    return any(p in head for p in NOT_FOUND)


def normalized(text: str) -> str:
    return " ".join(normalize_for_lexical(text).split())


_folded = lambda words: frozenset(map(normalized, words))
_UNITS, _TENS, _SCALES = ({k: _folded(v) for k, v in t.items()} for t in (UNITS, TENS, SCALES))
_ANY = {k: _UNITS[k] | _TENS[k] | _SCALES[k] for k in UNITS}
_ALL_SCALES = _SCALES["tr"] | _SCALES["en"]


def _digits(word: str) -> bool:
    return word.isascii() and word.isdigit()


def _within_number(hay: str, start: int, needle: str) -> bool:
    """Whether the words at ``start`` are part of a longer number in words."""
    before = re.search(r"(?:^|[\W_])([^\W_]*)[\W_]*$", hay[:start])
    previous = before[1] if before else ""
    rest = hay[start + len(needle) :]
    after = re.match(r"[\W_]*([^\W_]*)", rest)[1]
    first, last = needle.split(" ")[0], needle.split(" ")[-1]
    if any(first in _ANY[k] and previous in _TENS[k] | _SCALES[k] for k in _ANY):
        return True
    number = _digits(last) or any(last in _ANY[k] for k in _ANY)
    goes_on = after in _ALL_SCALES or (last in _ALL_SCALES and (_digits(after) or any(after in _ANY[k] for k in _ANY)))
    return bool(number and rest[:1] and not rest[0].isalnum() and goes_on)


def contains_term(hay: str, needle: str) -> bool:
    """Whether ``needle`` begins a word in ``hay``; its end is open but after a
    digit, and a longer number does not hold a shorter one."""
    digit = lambda s: s.isascii() and s.isdigit()
    at = hay.find(needle)
    while at >= 0:
        b, a = hay[max(0, at - 2) : at], hay[at + len(needle) : at + len(needle) + 2]
        left = b[-1:].isalnum() or (digit(needle[:1]) and len(b) == 2 and b[1] == "." and digit(b[0]))
        right = digit(needle[-1:]) and (digit(a[:1]) or (len(a) == 2 and a[0] == "." and digit(a[1])))
        if not left and not right and not _within_number(hay, at, needle):
            return True
        at = hay.find(needle, at + max(1, len(needle)))
    return False


def found_facts(answer: str, expect: list[str], refused: bool) -> list[int]:
    """Indexes of the expected texts (alternatives parted by |) that the answer holds."""
    if refused:
        return []
    hay = normalized(answer)
    return [i for i, text in enumerate(expect) if any(contains_term(hay, normalized(t)) for t in text.split("|"))]


# --- reranker windows ----------------------------------------------------------


def _keys(query: str) -> list[tuple[str, bool]]:
    """(text, whole): what each term of three characters or more looks for."""
    terms = [t for t in lexical_terms(query) if len(t) >= 3]
    return list(dict.fromkeys((t, True) if any(unicodedata.category(c)[0] == "N" for c in t) else (t[:5], False) for t in terms))


def _pieces(text: str, most: int) -> list[str]:
    out = []
    for sentence in re.findall(r"[^.!?;\n]*[.!?;\n]\s*|[^.!?;\n]+$", text):
        half = max(1, most // 2)
        if len(sentence) > most:
            while len(sentence) > half:
                head = sentence[:half]
                cut = max((m.end() for m in re.finditer(r"\s", head)), default=0) or max((m.end() for m in re.finditer(r"[\W_]", head)), default=0) or half
                out.append(sentence[:cut])
                sentence = sentence[cut:]
        if sentence:
            out.append(sentence)
    return out


def passage_window(query: str, text: str, most: int) -> str | None:
    """The part of ``text`` that a reranker reads: the piece that meets most keys,
    grown forwards, then backwards. None if no piece meets any."""
    if len(text) <= most:
        return text
    keys = _keys(query)

    def met(piece: str) -> int:
        words = set(re.findall(r"[^\W_]+", normalize_for_lexical(piece)))
        return sum(1 for k, whole in keys if (k in words if whole else any(w.startswith(k) for w in words)))

    pieces = _pieces(text, most)
    scores = [met(p) for p in pieces]
    if not any(scores):
        return None
    a = scores.index(max(scores))
    b, size = a + 1, len(pieces[a])
    while True:
        if b < len(pieces) and size + len(pieces[b]) <= most:
            size += len(pieces[b])
            b += 1
        elif a and size + len(pieces[a - 1]) <= most:
            a -= 1
            size += len(pieces[a])
        else:
            return "".join(pieces[a:b])[:most].strip()


# --- prompts ---------------------------------------------------------------------

_LINE_BREAK = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]")


def source_label(title: str | None, filename: str | None, path: list[str]) -> str:
    parts = [title if title is not None else filename or "", *(h for h in path if h != title)]
    return " > ".join(p for p in parts if p)


def source_block(number: int, label: str, text: str) -> str:
    """A numbered source; every line of its text is quoted, so none can pass for a header."""
    return f"\n[{number}] {label}\n" + "".join(f"| {line}\n" for line in _LINE_BREAK.split(text))


# --- columns ---------------------------------------------------------------------


def _citations(answer: pd.Series, sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_citations(a or "", int(n)) for a, n in zip(answer, sources)], columns=["valid", "invalid", "markers"])


def citations(answer: str | Column, sources: str | Column) -> Column:
    return F.pandas_udf(_citations, "struct<valid:array<int>,invalid:array<int>,markers:array<struct<start:int,end:int,numbers:array<int>>>>")(answer, sources)



def _is_abstention(answer: pd.Series) -> pd.Series:
    return answer.fillna("").map(abstained)


def is_abstention(answer: str | Column) -> Column:
    return F.pandas_udf(_is_abstention, "boolean")(answer)



def _facts(answer: pd.Series, expect: pd.Series, refused: pd.Series) -> pd.Series:
    return pd.Series([found_facts(a or "", list(e), bool(r)) for a, e, r in zip(answer, expect, refused)])


def facts(answer: str | Column, expect: str | Column, refused: str | Column) -> Column:
    return F.pandas_udf(_facts, "array<int>")(answer, expect, refused)



def cited_numbers(answer: str | Column) -> Column:
    """Numbers cited in brackets, ranges expanded, each once in first-seen order."""
    x = F.col(answer) if isinstance(answer, str) else answer
    part = r"\s*\^*\s*(?:0|[1-9]\d{0,2})\s*(?:[-–—−]\s*(?:0|[1-9]\d{0,2})\s*)?\\*\s*"
    inside = F.filter(F.regexp_extract_all(x, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda s: s.rlike(rf"^{part}(?:,{part})*$"))
    ends = F.transform(F.flatten(F.transform(inside, lambda s: F.split(s, ","))), lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int")))
    sound = F.filter(ends, lambda e: (e[0] <= F.element_at(e, -1)) & (F.element_at(e, -1) - e[0] <= MAX_RANGE))
    return F.array_distinct(F.flatten(F.transform(sound, lambda e: F.sequence(e[0], F.element_at(e, -1)))))

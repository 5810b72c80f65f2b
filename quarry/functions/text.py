"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a query: at most so many, from so many leading characters.
MAX_QUERY_TERMS, MAX_QUERY_CHARS = 32, 4096
TERM = r"[\p{L}\p{N}\p{M}]+"
#: Letters that terms do not tell apart, after lower case.
FOLDED = (("ı", "i"), ("â", "a"), ("î", "i"), ("û", "u"), ("ß", "ss"))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: str | Column) -> Column:
    """Lexical normalization of text that is composed and free of compatibility
    characters; ``normalize.normalize_for_lexical`` is the exact form. Lower case
    makes two code points of the dotted capital I, which the first replacement
    folds; replacements search bytes, unlike a translation, which looks up every character."""
    x = F.lower(_c(text))
    for before, after in (("i\u0307", "i"), *FOLDED):
        x = F.replace(x, F.lit(before), F.lit(after))
    return x


def tokens(folded: str | Column) -> Column:
    """Terms of folded text in order, repeats included."""
    return F.regexp_extract_all(_c(folded), F.lit(TERM), F.lit(0))


def query_terms(text: str | Column) -> Column:
    """Distinct terms in first-seen order, within the caps. A term that the
    length cap cuts in two is dropped."""
    x = _c(text)
    head = fold(F.substring(x, 1, MAX_QUERY_CHARS))
    cut = head.rlike(r"[\p{L}\p{N}\p{M}]$") & F.substring(x, MAX_QUERY_CHARS + 1, 1).rlike(r"[\p{L}\p{N}\p{M}]")
    found = tokens(head)
    whole = F.when(cut, F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
    return F.slice(F.array_distinct(F.filter(whole, lambda t: t.rlike(r"[\p{L}\p{N}]"))), 1, MAX_QUERY_TERMS)


def squash(text: str | Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def excerpt(text: str | Column, chars: int = 280) -> Column:
    return F.substring(_c(text), 1, chars)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+"))


def lexical_text(path: str | Column, body: str | Column) -> Column:
    """What the term index holds of a chunk: its heading path and its body."""
    joined = F.array_join(_c(path), " > ")
    return F.when(joined == "", _c(body)).otherwise(F.concat(joined, F.lit("\n\n"), _c(body)))


def line_key(line: str | Column) -> Column:
    """A line without its number and bullets, for finding repeats."""
    bare = F.regexp_replace(_c(line), r"^\s*(?:\d+[.)]\s+)?(?:[*\-•]\s+)*", "")
    return squash(bare)


def distinct_line_ratio(text: str | Column) -> Column:
    """Distinct line keys over all non-empty lines; 1.0 without any."""
    keys = F.filter(F.transform(F.split(_c(text), "\r?\n"), line_key), lambda k: k != "")
    return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct(keys)) / F.size(keys))


def sentences(text: str | Column) -> Column:
    """Pieces that end after ``. ! ? ;`` or a line's end and the white space there;
    together they are the text again."""
    return F.filter(F.regexp_extract_all(_c(text), F.lit(r"[^.!?;\n]*(?:[.!?;\n]\s*|$)"), F.lit(0)), lambda s: s != "")


def join_hyphenated(text: str | Column) -> Column:
    """Words broken over lines joined; after a one-letter prefix the hyphen stays."""
    kept = F.regexp_replace(_c(text), r"(?<![\p{L}])(\p{L})-\r?\n(?=\p{Ll})", "$1-")
    return F.regexp_replace(kept, r"(?<=\p{L})[-\x{AD}]\r?\n(?=\p{Ll})", "")


def strip_footnote(text: str | Column) -> Column:
    """Without the digits glued to a last word of at least four letters."""
    return F.regexp_replace(squash(text), r"(\p{L}{4,})\d+$", "$1")


def think_free(text: str | Column) -> Column:
    """Without closed think spans and the white space after them."""
    return F.regexp_replace(_c(text), r"(?s)<think>.*?</think>\s*", "")


def neutral_markers(text: str | Column) -> Column:
    """Chat markers broken by a space, so no text can end its own message."""
    return F.replace(F.replace(_c(text), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def judge_verdict(text: str | Column) -> Column:
    """True or false for a first word YES or NO, else null."""
    word = F.upper(F.regexp_extract(_c(text), r"^[^\p{L}]*(\p{L}+)", 1))
    return F.when(word == "YES", True).when(word == "NO", False)


def name_key(name: str | Column) -> Column:
    """The key by which collection names are unique."""
    return F.lower(F.translate(_c(name), "İIı", "iii"))


def valid_name(name: str | Column) -> Column:
    """1 to 64 letters, digits, spaces and ``_.-`` without space around."""
    x = _c(name)
    return x.rlike(r"^[\p{L}\p{N}\p{M} _.\-]{1,64}$") & (F.trim(x) == x)


def clean_filename(name: str | Column) -> Column:
    """The last path component, or null for none or one with control characters or over 255 long."""
    last = F.element_at(F.split(_c(name), r"[/\\]"), -1)
    bad = last.isin("", ".", "..") | last.rlike(r"[\p{Cc}\x{2028}\x{2029}]") | (F.length(last) > 255)
    return F.when(~bad, last)


def chat_line(role: str | Column, text: str | Column) -> Column:
    """One message in chat markup."""
    return F.concat(F.lit("<|im_start|>"), _c(role), F.lit("\n"), neutral_markers(text), F.lit("<|im_end|>"))


def suspicious(text: str | Column) -> Column:
    """Why text looks garbled: ``unmapped characters``, ``words split into single
    letters`` or null. Texts under 200 visible characters are not judged."""
    x = _c(text)
    solid = F.regexp_replace(x, r"\s", "")
    n = F.length(solid)
    unmapped = n - F.length(F.regexp_replace(solid, r"[\x{FFFD}\p{Cc}]", ""))
    words = F.regexp_count(x, F.lit(r"\S+"))
    runs = F.regexp_extract_all(x, F.lit(r"(?<!\S)\p{L}(?:\s+\p{L}){3,}(?!\S)"), F.lit(0))
    split = F.aggregate(runs, F.lit(0), lambda s, r: s + F.regexp_count(r, F.lit(r"\S+")))
    return F.when(n < 200, F.lit(None)).when(unmapped * 1000 >= n * 10, F.lit("unmapped characters")).when(split * 100 >= words * 40, F.lit("words split into single letters"))


def html_text(html: str | Column) -> Column:
    """Visible text of ordinary HTML: comments, scripts and styles dropped, tags
    as spaces, common entities decoded. ``sources.markup.html_to_text`` is exact."""
    x = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script[^>]*>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style[^>]*>", " ")
    x = F.regexp_replace(x, r"</?[A-Za-z!?/][^<>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x

"""Names of collections and files: composed, compared and checked.

Only names with characters from U+0300 on can change when they are composed, so
others stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.normalize import IGNORED_CLASS

MAX_FILENAME_CHARS = 255


def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFC", n), na_action="ignore")


def nfc(name: str | Column) -> Column:
    """The name in composed form."""
    x = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(x.rlike(r"[^\x00-\x{2FF}]"), x)), x)


def name_key(name: str | Column) -> Column:
    """The key by which collection names are unique."""
    return text.name_key(nfc(name))


def valid_name(name: str | Column) -> Column:
    """Whether a collection may have the name, once it is composed."""
    return shown(nfc(name))


def shown(composed: str | Column) -> Column:
    """Whether a composed name is valid and has nothing in it that is not shown."""
    x = F.col(composed) if isinstance(composed, str) else composed
    return text.valid_name(x) & x.rlike(r"^[\p{IsAlphabetic}\p{N} _.\-]*\z") & ~x.rlike(IGNORED_CLASS)


def filename(name: str | Column) -> Column:
    """struct<name, error>: the last part of a path, composed and trimmed, null for none. A name that is too long
    or does not show all of its characters (controls, invisible ones, line breaks) is an error."""
    last = F.trim(F.element_at(F.split(nfc(name), r"[/\\]"), -1))
    there = F.when(~last.isin("", ".", ".."), last)
    hidden = there.rlike(r"[\p{Cc}\x{2028}\x{2029}]") | there.rlike(IGNORED_CLASS) | (F.length(there) > MAX_FILENAME_CHARS)
    error = F.when(hidden, "the file name is too long or has invisible characters")
    return F.struct(F.when(error.isNull(), there).alias("name"), error.alias("error"))

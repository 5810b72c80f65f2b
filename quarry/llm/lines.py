"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last few lines ends a chunk wherever it
falls on a divisor, so chunks depend on nearby lines alone and realign after
lines come or go. Chunks of several lines that occur before (in a smaller
doc_id, or earlier in the document) are removed once their bytes have been
compared.

DataFrame functions only. Chunks travel as hashes and lengths. Documents meet
the list of their repeated chunks by doc_id; the bytes of repeated chunks alone
are then compared, by the least and greatest of each hash's bytes, which
combines before the shuffle and holds for a chunk found in a third of all
documents. Keys whose bytes differ (a collision) remove nothing.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; single-line chunks stay; a null id is larger than all others; rows
that repeat an id and text keep the same first occurrence; an
empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LAST = 2**63 - 1
_MULTIPLIER = 1_000_003
_MODULUS = 2**31 - 1


def line_hash(line: Column) -> Column:
    """The first 28 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _at(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _size(code: Column) -> Column:
    return code.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _chunk(code: Column) -> Column:
    """The bytes of a chunk of ``_lines``."""
    return F.array_join(F.slice("_lines", _at(code), _size(code)), "\n")


def with_chunks(df: DataFrame, text: str, window: int, divisor: int) -> DataFrame:
    """``df`` with ``_lines`` of a text column and ``_codes`` of its chunks: the first
    line, counted from 1, in the upper half of a number and how many in the lower.
    Numbers make sets of chunks fit for array functions that hash."""
    known = F.col("_hashes")

    def rolled(i: Column) -> Column:
        value = F.lit(0).cast("long")
        for k in range(window):
            value = (value * _MULTIPLIER + F.coalesce(F.get(known, i - (window - 1 - k)), F.lit(0))) % _MODULUS
        return value

    n = F.size("_lines")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolled(i - 1) % divisor == 0))
    before = lambda k: F.coalesce(F.get("_ends", k - 1), F.lit(0)).cast("long")
    codes = F.transform("_ends", lambda e, k: F.shiftleft(before(k) + 1, 32) + (e - before(k)))
    return (
        df.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
        .withColumn("_hashes", F.transform("_lines", line_hash))
        .withColumn("_ends", ends)
        .withColumn("_codes", codes)
        .drop("_hashes", "_ends")
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2,
    divisor: int = 2,
    least_lines: int = 2,
) -> DataFrame:
    """All rows and columns of ``docs`` with the text that stays, ``n_lines`` and ``n_removed_lines``
    (those two under names with underscores before them where they clash)."""
    names = docs.columns
    key = ["_id", "_mark"]
    # the other columns travel as one struct, so no name of theirs can clash
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.struct(*others).alias("_row"))
    # rows that share an id and differ in text are told apart
    own = own.withColumn("_mark", F.xxhash64("_text"))
    slim = own.select(*key, "_text")
    several = F.filter("_codes", lambda c: _size(c) >= least_lines)
    hashed = F.transform(several, lambda c: F.struct(c.alias("code"), F.xxhash64(_chunk(c)).alias("h1"), F.xxhash64(F.lit(1), _chunk(c)).alias("h2")))
    occurring = with_chunks(slim, "_text", window, divisor).select(*key, F.explode(hashed).alias("c")).select(*key, "c.*")
    place = F.struct("_id", "code")
    repeated = occurring.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    met = occurring.join(repeated, ["h1", "h2"])
    listed = met.groupBy(*key).agg(F.collect_set("code").alias("_listed"), F.collect_set(F.when(place != F.col("first"), F.col("code"))).alias("_gone"))

    # the bytes of repeated chunks, compared through the least and greatest of each key
    found = with_chunks(slim.join(listed.select(*key, "_listed"), key), "_text", window, divisor)
    held = found.select(F.explode(F.transform("_listed", _chunk)).alias("bytes"))
    collided = (
        held.groupBy(F.xxhash64("bytes").alias("h1"), F.xxhash64(F.lit(1), "bytes").alias("h2"))
        .agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).filter("lo != hi").select("h1", "h2")
    )
    spared = occurring.join(collided, ["h1", "h2"]).groupBy(*key).agg(F.collect_set("code").alias("_spared"))

    lines_out, removed_out = (f"_{c}" if c in names else c for c in ("n_lines", "n_removed_lines"))
    # a null text has a null mark, meets no list and stays as it is
    whole = with_chunks(own.join(listed.select(*key, "_gone"), key, "left").join(spared, key, "left"), "_text", window, divisor)
    none = F.array().cast("array<bigint>")
    gone = F.array_except(F.coalesce("_gone", none), F.coalesce("_spared", none))
    stays = F.when(F.col("_gone").isNull(), F.col("_codes")).otherwise(F.array_except("_codes", gone))
    empty = F.col("_text").isNull()
    done = whole.withColumn("_stays", stays).withColumn("_kept", F.flatten(F.transform("_stays", lambda c: F.slice("_lines", _at(c), _size(c)))))
    return done.select(
        *(F.when(~empty, F.array_join("_kept", "\n")).alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in names),
        F.when(empty, 0).otherwise(F.size("_lines")).cast("long").alias(lines_out),
        F.when(empty, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias(removed_out),
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i,
         len(string_split(text, chr(10))) AS n
  FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines
), marked AS (
  SELECT *, CASE WHEN i = n OR ((coalesce(lag(h) OVER w, 0) % 2147483647) * 1000003 + h) % 2147483647 % 2 = 0 THEN 1 ELSE 0 END AS ends FROM hashed
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM marked
), chunks AS (
  SELECT doc_id, chunk, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk
), judged AS (
  SELECT *, size >= 2 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(size)::BIGINT AS n_lines, sum(CASE WHEN gone THEN size ELSE 0 END)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document's and two sketches of very unequal documents give
their containment; the sketch of a union is the union of the sketches. A
document's smallest hash is kept too, whatever its value, so that no document
with words has an empty sketch; unions keep that property.

A sketch travels as a sorted array of hashes, or as text (``encoded``): 16 hex
digits a hash, in order, so that fingerprints that were written can be read
back (``decoded``), merged and compared. With a fraction of 1 in f, a document of n
shingles keeps about n / f, and a likeness of J over u shingles in all has a standard
error of about sqrt(J (1 - J) f / u): 0.03 at J = 0.5, f = 4 and 1000 shingles, 0.5 at
f = 1000. A larger f makes smaller sketches for longer documents.

DataFrame functions only. Words: maximal runs without ASCII white space, in
lower case; with fewer words than a shingle, all of them form one.

Defined results: a null text is an empty one, whose sketch is empty; two empty
sketches are alike (1.0), an empty and another are not (0.0); a null id counts as
the smallest of all; where ids repeat, each row is fingerprinted and the one with the smallest text is the "next"
document; a single document is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_BREAK, keyed_text, settle

_FIRST = -(2**63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str, width: int = 5, fraction: int = 4) -> DataFrame:
    """``df`` with the sorted sketch of a text column: hashes in the lowest
    1/``fraction`` of the range, and the smallest hash of all."""
    w, s = f"{name}_words", f"{name}_all"
    top = _FIRST + 2**64 // fraction
    shingle = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    rolled = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), shingle))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.size(w), F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    low = F.array_sort(F.array_distinct(F.filter(s, lambda h: h < top)))
    return (
        df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
        .withColumn(s, F.coalesce(rolled, whole))
        .withColumn(name, F.when((F.size(low) > 0) | (F.size(s) == 0), low).otherwise(F.array(F.array_min(s))))
        .drop(w, s)
    )


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of the documents of two sketches."""
    same = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - same
    return F.when(union == 0, F.lit(1.0)).otherwise(same / union)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of the first sketch's document that the second's holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str | Column, b: str | Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def encoded(sketch: str | Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def decoded(fingerprint: str | Column) -> Column:
    """The sketch that ``encoded`` wrote."""
    text = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9a-f]{16}"), F.lit(0)), lambda h: F.conv(h, 16, -10).cast("long"))


def neighbours(ids: DataFrame, least_rows: int = 200_000) -> tuple[DataFrame, bool]:
    """(doc_id, before, before_chars): for each id of ``ids`` (doc_id, n, times) the one that
    it follows in descending order (the next larger; for the largest, the
    smallest) and that document's length; and whether ids repeat. Ids are dealt
    to ranges of about ``least_rows`` by sampled quantiles, whatever their values
    are; neighbours are found within a range by a window, and over the ranges'
    edges, one row a range, likewise."""
    seen = ids.agg(F.count("*").alias("c"), F.max("times").alias("times")).first()
    ranges = max(1, -(-seen["c"] // least_rows))
    dealt = settle(ids.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()))
    here = F.struct(F.col("doc_id").alias("before"), F.col("n").alias("before_chars"))
    edges = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "n")).alias("first"))
    along = Window.orderBy("range")
    edges = edges.select(
        "range",
        F.coalesce(F.lead("first").over(along), F.min("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"),
    )
    within = Window.partitionBy("range").orderBy("doc_id")
    found = (
        dealt.withColumn("up", F.lead(here).over(within))
        .join(F.broadcast(edges) if ranges <= 100_000 else edges, "range")
        .select(
            "doc_id",
            F.coalesce("up.before", "beyond.doc_id").alias("before"),
            F.coalesce("up.before_chars", "beyond.n").alias("before_chars"),
        )
    )
    return found, (seen["times"] or 0) > 1


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, fraction: int = 4) -> DataFrame:
    """Sketches of every text, of its edited text (the last third of its code
    points replaced by the first as many of the next document, descending id),
    and how alike the sketch is to that one and to the next document's.

    A document hands its first code points and its sketch to the one before it. Texts
    and their sketches are dealt by id once, for both joins: what moves is those, a
    third of the texts and the sketches again. Each text is cut into shingles once."""
    keyed = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_FIRST)))
    ids = settle(keyed.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("times")))
    before, repeated = neighbours(ids)
    own = with_sketch(keyed, "text", "sketch", width, fraction).select("doc_id", "text", "sketch").repartition("doc_id")
    followed = own.join(before, "doc_id")
    if repeated:
        # repeated ids: the smallest text is the one that is handed on
        followed = followed.groupBy("doc_id", "before", "before_chars").agg(F.min(F.struct("text", "sketch")).alias("first")).select("before", "before_chars", "first.*")
    handed = followed.select(
        F.col("before").alias("doc_id"),
        F.expr("substring(text, 1, cast(floor(before_chars / 3) as int))").alias("head"),
        F.col("sketch").alias("next_sketch"),
    )
    chars = F.length("text")
    third = F.floor(chars / 3).cast("int")
    both = own.join(handed, "doc_id").select(
        "doc_id",
        "text",
        "sketch",
        "next_sketch",
        F.concat(F.substring("text", F.lit(1), (chars - third).cast("int")), F.substring("head", F.lit(1), third)).alias("edited"),
    )
    return with_sketch(both, "edited", "edited_sketch", width, fraction).withColumn("doc_id", F.when(F.col("doc_id") != _FIRST, F.col("doc_id")))

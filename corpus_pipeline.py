"""From raw documents to packed training sequences.

Five stages; each takes (spark, docs, sf_dir), works on every row that the one
before it left and returns the columns of documents (others of its input are
dropped, whatever their names), the last one pieces with their places. ``run``
writes each stage's rows as Parquet under the shared checkpoint folder and reads
them again, so a lost executor costs no earlier stage. No SQL: the classifier is
trained.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality
from quarry.llm.common import checkpoint_dir, documents, release_tables, settle, settle_table, settled_so_far
from quarry.llm.jaccard import jaccard_join
from quarry.llm.lines import line_dedup
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import pack_documents
from quarry.llm.queries import tokenizer_path

#: Ids of dropped copies are broadcast up to so many (8 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 500_000
#: Words of the packing stage's table in each Python worker, which still keeps what earlier stages took.
KNOWN_WORDS = 400_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more. A null text is scored as an empty
    one; ids play no part in a score, so rows without one, or that repeat one, are judged by their texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels)).select(COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier one holds. A null text stays null, a null id
    is the last, and of rows that repeat an id and a text each keeps what the first keeps."""
    cut = line_dedup(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest doc_id, a null being
    the largest. Where ids are repeated or null, rows are numbered and each is judged by its own
    text: of rows that repeat an id and a text one stays, and different texts of one id are apart."""
    if not docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        rows = settle_table(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
        parts = jaccard_join(rows, id_col="_row", count_links=False).select(F.col("doc_id").alias("_row"), "component_id")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
        kept = rows.select("_row", "doc_id").join(parts, "_row").groupBy("component_id").agg(first).select("first._row")
        return rows.join(kept, "_row", "left_semi").select(COLUMNS)
    copies = settle(jaccard_join(docs, count_links=False).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of source, language and topic. Null sources and languages
    are values of their own; rows of one id in one cell, and all rows without id in it, stay or go together."""
    return mix_sources(docs).filter("_selected").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document that is left, and its place in a sequence; a null text is
    one piece of the end id alone, and rows that repeat an id are documents of their own."""
    return pack_documents(docs, tokenizer_path(), known_words=KNOWN_WORDS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", reject_junk),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = settled_so_far()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        # what the stage was made from and what it settled on its way is of no more use
        release_tables(spark, before, *([f"{folder}/{k - 1}"] if k else []))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

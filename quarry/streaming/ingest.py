"""Incremental ingestion: files that arrive in a folder become indexed documents.

The file source's checkpoint remembers what was read; a batch that is run again
changes nothing, as contents are known by their hash within a collection. Files whose
bytes or names do not bear out their format are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import vectors
from quarry.operators import chunking
from quarry.operators.store import Store
from quarry.sources import formats, markup

_FILES = "path string, modificationTime timestamp, length long, content binary"


def prepare(document: DataFrame, config: chunking.ChunkerConfig, embed=vectors.fake_embedding) -> DataFrame:
    """Chunks with embeddings of (doc_id, blocks, pages); ``embed`` is a pandas UDF over text."""
    chunks = chunking.chunk(document, config)
    shown = F.when(F.col("breadcrumb") == "", F.col("text")).otherwise(F.concat("breadcrumb", F.lit("\n\n"), "text"))
    return chunks.withColumn("embedding", embed(shown))


def work(store: Store, config: chunking.ChunkerConfig = chunking.ChunkerConfig(), embed=vectors.fake_embedding, most: int = 10_000) -> int:
    """Runs queued jobs, oldest first and up to ``most`` at a time, until none is left; returns how many."""
    done = 0
    while n := (claimed := store.claim_batch(most)).count():
        done += n
        documents = store.table("documents").join(F.broadcast(claimed.withColumnRenamed("document", "id")), "id")
        source = documents.join(store.table("sources"), "sha256")
        parsed = source.select("job", F.col("id").alias("doc_id"), markup.parsed("bytes", "format").alias("p")).select("job", "doc_id", "p.*").persist()
        outcomes = parsed.select("job", F.col("doc_id").alias("document"), "title", "warnings", "error")
        chunks = prepare(parsed.filter("error IS NULL"), config, embed).withColumnRenamed("doc_id", "document_id")
        store.publish_batch(outcomes, chunks)
        parsed.unpersist()
        claimed.unpersist()
    return done


def ingest_stream(spark: SparkSession, folder: str, store: Store, collection: int, checkpoint: str, config: chunking.ChunkerConfig = chunking.ChunkerConfig(), available_now: bool = True) -> StreamingQuery:
    """Watches ``folder``; every micro-batch is queued and worked off. What a run before this one had
    begun and not ended is queued again first: a store has one writer at a time."""
    if not store.table("jobs").filter("status = 'running'").isEmpty():
        store.requeue_running()

    def batch(files: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        listed = formats.accepted(files.select(name.alias("filename"), "content"), "filename")
        store.enqueue(collection, listed.filter("error IS NULL").select("filename", F.col("kind").alias("format"), "content"))
        work(store, config)

    stream = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()

"""Collections, documents, jobs and the index, as versioned Parquet tables.

A table is a list of parts. What is only added (sources, chunks, postings, lengths)
is written as one more part, and parts are joined into one when there are many.
Documents and jobs, whose rows change, are in parts by ranges of ids: a change is a plan over
the ranges that it touches, whose result replaces them alone. Chunks of single documents
that are deleted are listed as gone, and reads leave them out until ``compact`` does it for good. A
manifest that is replaced in one step then names the parts, so a reader sees all of
a change or none of it, and a failed writer leaves the old state. One writer at a
time. Ids are taken from counters in the manifest and never reused. Queued
jobs are claimed and published many at a time, so that N documents cost N.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import names, text
from quarry.functions.identity import LEXICAL_VERSION, space_fingerprint
from quarry.operators import lexical

APPLICATION, SCHEMA_VERSION = "quarry-store", 4
PAGE_LIMIT = 200
#: Parts of a table, or of a range of ids, beyond which they are joined into one.
MOST_PARTS = 32
#: Tables whose rows change, in parts of so many ids.
RANGED, RANGE = ("documents", "jobs"), 100_000
SCHEMAS = {
    "spaces": "id long, fingerprint string, model_id string, dimensions int, created_at timestamp",
    "collections": "id long, name string, name_key string, space_id long, protected boolean, created_at timestamp",
    "sources": "sha256 string, size_bytes long, bytes binary",
    "documents": "id long, collection_id long, sha256 string, filename string, format string, title string, status string, error string, chunk_count long, warnings array<string>, created_at timestamp, updated_at timestamp",
    "jobs": "id long, document_id long, kind string, status string, error string, created_at timestamp, updated_at timestamp",
    "chunks": "id long, document_id long, collection_id long, ordinal int, heading_path array<string>, text string, token_count int, page_start int, page_end int, embedding array<float>",
    "postings": "chunk_id long, term string, tf long",
    "lengths": "chunk_id long, dl long",
    "gone": "chunk_id long",
}
#: By what chunks that are gone are left out of each table.
GONE_BY = {"chunks": "id", "postings": "chunk_id", "lengths": "chunk_id"}


class StoreError(ValueError):
    """A change that the current state does not allow."""


def _single_versions(manifest: dict) -> None:
    """Schema 4: a table is a list of parts, not one version."""
    manifest["tables"] = {name: [part] if isinstance(part, str) else part for name, part in manifest["tables"].items()}


def _range_of(column: str) -> Column:
    return F.floor(F.col(column) / RANGE).cast("long")


def _crowded(parts: list[str]) -> list[str]:
    """The parts of every range that has too many of them; a table without ranges is one."""
    by: dict[str, list[str]] = {}
    for p in parts:
        by.setdefault(p.rsplit("=", 1)[1] if "/_range=" in p else "", []).append(p)
    return [p for some in by.values() if len(some) > MOST_PARTS for p in some]


#: What brings a manifest from each schema to the next; run in order, each saved before the next.
MIGRATIONS = {3: _single_versions}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._manifest = self._load()
        if self._manifest is None:
            if self._fs.exists(self._path("")) and self._fs.listStatus(self._path("")):
                raise StoreError("the folder holds files of something else")
            self._manifest = {"application": APPLICATION, "schema": SCHEMA_VERSION, "lexical": LEXICAL_VERSION, "tables": {}, "next": {}}
            self._save()
        if self._manifest["application"] != APPLICATION:
            raise StoreError("the folder holds the tables of another application")
        if self._manifest["schema"] > SCHEMA_VERSION or self._manifest["lexical"] > LEXICAL_VERSION:
            raise StoreError("the tables were written by a newer version")
        while self._manifest["schema"] < SCHEMA_VERSION:
            if self._manifest["schema"] not in MIGRATIONS:
                raise StoreError("the tables are too old")
            MIGRATIONS[self._manifest["schema"]](self._manifest)
            self._manifest["schema"] += 1
            self._save()
        if self._manifest["lexical"] < LEXICAL_VERSION:
            self.rebuild_lexical()

    # -- tables

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _load(self) -> dict | None:
        if not self._fs.exists(self._path("manifest.json")):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest.json").collect()))

    def _save(self) -> None:
        fresh = self._path(f".manifest-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(self._manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark._sc._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        context.rename(fresh, self._path("manifest.json"), over)

    def table(self, name: str, ranges: set[int] | None = None, written: bool = False) -> DataFrame:
        """The current rows, or those of some ranges of ids (and maybe others); with ``written`` also what is gone."""
        parts = [f"{self.root}/{p}" for p in self._parts(name, ranges)[0]]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader = self.spark.read.schema(SCHEMAS[name])
        # each part of a partitioned table is a root of its own
        rows = reduce(DataFrame.unionByName, map(reader.parquet, parts)) if name == "chunks" else reader.parquet(*parts)
        if written or not self._manifest.get("deleted") or name not in (*GONE_BY, "sources"):
            return rows
        if name == "sources":
            return rows.join(self.table("documents").select("sha256").distinct(), "sha256", "left_semi")
        return rows.join(self.table("gone").withColumnRenamed("chunk_id", GONE_BY[name]), GONE_BY[name], "left_anti").select(rows.columns)

    def _write(self, name: str, df: DataFrame) -> list[str]:
        """New parts with the rows of ``df``."""
        part = f"{name}/{uuid.uuid4().hex}"
        rows = df.select([f.split()[0] for f in SCHEMAS[name].split(", ")])
        if name not in RANGED:
            (rows.write.partitionBy("collection_id") if name == "chunks" else rows.write).parquet(f"{self.root}/{part}")
            return [part]
        rows.withColumn("_range", _range_of("id")).repartition("_range").write.partitionBy("_range").parquet(f"{self.root}/{part}")
        listed = [f.getPath().getName() for f in self._fs.listStatus(self._path(part)) if f.isDirectory()]
        return [f"{part}/{d}" for d in sorted(listed) if d.startswith("_range=")]

    def _parts(self, name: str, ranges: set[int] | None) -> tuple[list[str], list[str]]:
        """Parts that hold ids of ``ranges`` (all if None), and the others. Parts of older versions hold any."""
        within = lambda p: ranges is None or "/_range=" not in p or int(p.rsplit("=", 1)[1]) in ranges
        parts = self._manifest["tables"].get(name, [])
        return [p for p in parts if within(p)], [p for p in parts if not within(p)]

    def _touched(self, ids: DataFrame, column: str = "id") -> set[int]:
        """The ranges of some ids: few, as a batch's ids follow each other."""
        return {r[0] for r in ids.select(_range_of(column)).distinct().collect()}

    def _commit(self, added: Mapping[str, DataFrame] | None = None, changed: Mapping[str, tuple[set[int], DataFrame]] | None = None, **tables: DataFrame) -> None:
        """New versions of ``tables``, new rows of the ranges of ids that are ``changed``, and rows that are ``added``."""
        versions = {name: self._write(name, df) for name, df in tables.items()}
        for name, (ranges, df) in (changed or {}).items():
            versions[name] = [*self._parts(name, ranges)[1], *self._write(name, df)]
        for name, df in (added or {}).items():
            parts = [*versions.get(name, self._manifest["tables"].get(name, [])), *self._write(name, df)]
            full = _crowded(parts)
            if full:
                both = self.spark.read.schema(SCHEMAS[name])
                rows = reduce(DataFrame.unionByName, map(both.parquet, (f"{self.root}/{p}" for p in full)))
                parts = [*(p for p in parts if p not in full), *self._write(name, rows)]
            versions[name] = parts
        self._manifest["tables"].update(versions)
        self._save()

    def _ids(self, kind: str, n: int = 1) -> int:
        first = self._manifest["next"].get(kind, 1)
        self._manifest["next"][kind] = first + n
        return first

    def _numbered(self, kind: str, keys: DataFrame, key: str) -> tuple[DataFrame, int]:
        """``keys`` with a new ``number`` each, in order, and how many: ranges of keys are counted, then
        numbered within; no window sees more than a range, or one row of each."""
        ranged = keys.select(key).repartitionByRange(key).withColumn("_range", F.spark_partition_id()).persist()
        counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
        before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
        first = self._ids(kind, total)
        place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
        out = ranged.withColumn("_place", place).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_place") + first).cast("long").alias("number")).persist()
        out.count()
        ranged.unpersist()
        return out, total

    def _one(self, df: DataFrame, what: str):
        row = df.limit(1).collect()
        if not row:
            raise StoreError(f"no such {what}")
        return row[0]

    # -- collections

    def create_collection(self, name: str, protected: bool = False) -> int:
        name = unicodedata.normalize("NFC", name)
        new = self.spark.createDataFrame([(name,)], "name string").withColumn("name_key", text.name_key("name"))
        if not new.filter(names.shown("name")).count():
            raise StoreError("a name has 1 to 64 letters, digits, spaces and _.- and no space around")
        if new.join(self.table("collections"), "name_key", "left_semi").count():
            raise StoreError("the name is taken")
        key = self._ids("collections")
        row = new.select(F.lit(key).alias("id"), "name", "name_key", F.lit(None).cast("long").alias("space_id"), F.lit(protected).alias("protected"), F.current_timestamp().alias("created_at"))
        self._commit(collections=self.table("collections").unionByName(row))
        return key

    def collections(self) -> DataFrame:
        """Every collection with how many documents it has."""
        counts = self.table("documents").groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("document_count"))
        return self.table("collections").join(counts, "id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0))).orderBy("id")

    def delete_collection(self, key: int) -> None:
        if self._one(self.table("collections").filter(F.col("id") == key), "collection")["protected"]:
            raise StoreError("the default collection stays")
        keep = self.table("documents").filter(F.col("collection_id") != key)
        self._keep_documents(keep, collections=self.table("collections").filter(F.col("id") != key))

    def _keep_documents(self, keep: DataFrame, **more: DataFrame) -> None:
        """Drops what belongs to other documents than ``keep``, and sources and spaces without use."""
        ids = keep.select(F.col("id").alias("document_id"))
        chunks = self.table("chunks").join(ids, "document_id", "left_semi")
        inside = chunks.select(F.col("id").alias("chunk_id"))
        collections = more.get("collections", self.table("collections"))
        self._commit(
            documents=keep,
            jobs=self.table("jobs").join(ids, "document_id", "left_semi"),
            chunks=chunks,
            postings=self.table("postings").join(inside, "chunk_id", "left_semi"),
            lengths=self.table("lengths").join(inside, "chunk_id", "left_semi"),
            sources=self.table("sources").join(keep.select("sha256"), "sha256", "left_semi"),
            spaces=self.table("spaces").join(collections.select(F.col("space_id").alias("id")), "id", "left_semi"),
            **more,
        )

    # -- documents and jobs

    def enqueue(self, collection: int, files: DataFrame) -> DataFrame:
        """Adds files (filename, format, content) to a collection: (sha256, document_id,
        duplicate). Equal contents are one document; a failed one is queued again."""
        self._one(self.table("collections").filter(F.col("id") == collection), "collection")
        given = files.filter(F.length("content") > 0).withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"]).cache()
        documents, jobs = self.table("documents"), self.table("jobs")
        here = documents.filter(F.col("collection_id") == collection)
        new = given.join(here, "sha256", "left_anti")
        numbered, _ = self._numbered("documents", new, "sha256")
        now = F.current_timestamp()
        added = new.join(numbered, "sha256").select(
            F.col("number").alias("id"), F.lit(collection).cast("long").alias("collection_id"), "sha256", names.filename("filename")["name"].alias("filename"), "format",
            F.lit(None).cast("string").alias("title"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("chunk_count"),
            F.array().cast("array<string>").alias("warnings"), now.alias("created_at"), now.alias("updated_at"),
        )
        again = here.join(given.select("sha256"), "sha256", "left_semi").filter("status = 'failed'").select("id")
        is_again, ranges = F.col("again").isNotNull(), self._touched(again)
        kept = self.table("documents", ranges).join(again.withColumn("again", F.lit(1)), "id", "left").withColumns(
            {"status": F.when(is_again, "queued").otherwise(F.col("status")), "error": F.when(~is_again, F.col("error"))}
        )
        queued = again.unionByName(added.select("id"))
        order = self._numbered("jobs", queued.select(F.col("id").alias("document_id")), "document_id")[0].withColumnRenamed("number", "id")
        opened = order.select("id", "document_id", F.lit("ingest").alias("kind"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"))
        # the bytes of a document that was deleted may still be there, and then serve again
        sources = self.table("sources", written=True)
        fresh = given.join(sources, "sha256", "left_anti").select("sha256", F.length("content").cast("long").alias("size_bytes"), F.col("content").alias("bytes"))
        self._commit({"sources": fresh, "jobs": opened, "documents": added}, {"documents": (ranges, kept.drop("again"))} if ranges else None)
        queued_now = order.select(F.col("document_id"), F.lit(False).alias("duplicate"))
        out = self.table("documents").filter(F.col("collection_id") == collection).join(given.select("sha256"), "sha256", "left_semi")
        return out.select("sha256", F.col("id").alias("document_id")).join(queued_now, "document_id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))

    def page(self, collection: int, after: int = 0, limit: int = 50) -> tuple[list, int | None]:
        """Documents after an id, and the id to go on after (None at the end)."""
        if not 1 <= limit <= PAGE_LIMIT:
            raise StoreError(f"a page has 1 to {PAGE_LIMIT} documents")
        rows = self.table("documents").filter((F.col("collection_id") == collection) & (F.col("id") > after)).orderBy("id").limit(limit).collect()
        return rows, rows[-1]["id"] if len(rows) == limit else None

    def source_of(self, document: int):
        return self._one(self.table("documents").filter(F.col("id") == document).join(self.table("sources"), "sha256"), "document")

    def delete_document(self, document: int) -> None:
        """Drops a document with its jobs and chunks, and its source if no other document has it. Nothing is
        rewritten but the ranges of its ids: its chunks are gone for readers, on disk until ``compact``."""
        ranges = {document // RANGE}
        self._one(self.table("documents", ranges).filter(F.col("id") == document), "document")
        mine = F.col("document_id") == document
        job_ranges = self._touched(self.table("jobs").filter(mine))
        changed = {"documents": (ranges, self.table("documents", ranges).filter(F.col("id") != document)), "jobs": (job_ranges, self.table("jobs", job_ranges).filter(~mine))}
        gone = self.table("chunks").filter(mine).select(F.col("id").alias("chunk_id"))
        self._manifest["deleted"] = self._manifest.get("deleted", 0) + 1
        self._commit({"gone": gone}, changed)

    def compact(self) -> None:
        """Writes the tables without what single deletions left in them."""
        if self._manifest.get("deleted"):
            tables = {name: self.table(name) for name in (*GONE_BY, "sources")}
            self._manifest["deleted"] = 0
            self._commit(**tables, gone=self.spark.createDataFrame([], SCHEMAS["gone"]))

    def _set(self, name: str, which, ranges: set[int] | None = None, **values) -> DataFrame:
        return self.table(name, ranges).withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in (values | {"updated_at": F.current_timestamp()}).items()})

    def _oldest(self, most: int) -> DataFrame:
        """The ``most`` oldest queued jobs: ranges of ids are looked through from the first that had any, ever more at a time."""
        known = sorted({int(p.rsplit("=", 1)[1]) for p in self._manifest["tables"].get("jobs", []) if "/_range=" in p})
        known = [r for r in known if r >= self._manifest.get("queued_from", 0)]
        step = 2
        while True:
            taken = self.table("jobs", set(known[:step])).filter("status = 'queued'").orderBy("id").limit(most).select(F.col("id").alias("job"), F.col("document_id").alias("document")).persist()
            if taken.count() >= most or step >= len(known):
                return taken
            taken.unpersist()
            step *= 2

    def claim_batch(self, most: int = 10_000) -> DataFrame:
        """The ``most`` oldest queued jobs start: (job, document)."""
        taken = self._oldest(most)
        first = taken.agg(F.min("job").alias("first")).first()["first"]
        if first is not None:
            self._manifest["queued_from"] = first // RANGE
            changed = {}
            for name, column, status in (("jobs", "job", "running"), ("documents", "document", "indexing")):
                ranges, which = self._touched(taken, column), F.broadcast(taken.select(F.col(column).alias("id"), F.lit(1).alias("_t")))
                now = {"status": F.when(F.col("_t") == 1, status).otherwise(F.col("status")), "updated_at": F.when(F.col("_t") == 1, F.current_timestamp()).otherwise(F.col("updated_at"))}
                changed[name] = (ranges, self.table(name, ranges).join(which, "id", "left").withColumns(now).drop("_t"))
            self._commit(changed=changed)
        return taken

    def claim(self) -> tuple[int, int] | None:
        """The oldest queued job starts: (job, document)."""
        row = self.claim_batch(1).collect()
        return (row[0]["job"], row[0]["document"]) if row else None

    def fail(self, job: int, message: str) -> None:
        row = self._one(self.table("jobs").filter((F.col("id") == job) & (F.col("status") == "running")), "running job")
        failed, changed = {"status": F.lit("failed"), "error": F.lit(message)}, {}
        for name, key in (("jobs", job), ("documents", row["document_id"])):
            changed[name] = ({key // RANGE}, self._set(name, F.col("id") == key, {key // RANGE}, **failed))
        self._commit(changed=changed)

    def requeue_running(self) -> None:
        """After a restart: what was running is queued again."""
        self._manifest["queued_from"] = 0
        self._commit(
            jobs=self._set("jobs", F.col("status") == "running", status=F.lit("queued")),
            documents=self._set("documents", F.col("status") == "indexing", status=F.lit("queued")),
        )

    def publish(self, job: int, chunks: DataFrame, title: str | None = None, warnings: list[str] | None = None) -> bool:
        """Replaces the chunks (ordinal, heading_path, text, token_count, page_start, page_end,
        embedding) of a job's document. False, and nothing, if the job no longer runs."""
        row = self.table("jobs").filter((F.col("id") == job) & (F.col("status") == "running")).select(F.col("id").alias("job"), F.col("document_id").alias("document")).collect()
        if not row:
            return False
        outcome = self.spark.createDataFrame([(row[0]["job"], row[0]["document"], title, warnings or [], None)], "job long, document long, title string, warnings array<string>, error string")
        return self.publish_batch(outcome, chunks.withColumn("document_id", F.lit(row[0]["document"]).cast("long"))) == 1

    def publish_batch(self, outcomes: DataFrame, chunks: DataFrame) -> int:
        """Ends the jobs of ``outcomes`` (job, document, title, warnings, error) that still run: documents
        without an error get their ``chunks`` (document_id and what ``publish`` takes), others fail.
        Rows are added; only documents that had chunks before cost a new version of the index."""
        outcomes = outcomes.persist()
        job_ranges, document_ranges = self._touched(outcomes, "job"), self._touched(outcomes, "document")
        running = self.table("jobs", job_ranges).filter("status = 'running'").select(F.col("id").alias("job"))
        open_ = self.table("documents", document_ranges).filter("status = 'indexing'").select(F.col("id").alias("document"), "collection_id", (F.col("chunk_count") > 0).alias("had"))
        ended = outcomes.join(running, "job").join(open_, "document").persist()
        sound = ended.filter("error IS NULL").select(F.col("document").alias("document_id"), "collection_id")
        given = chunks.drop("collection_id").join(sound, "document_id").persist()
        counts = given.groupBy("document_id").agg(F.count("*").alias("chunk_count")).persist()
        total = counts.agg(F.sum("chunk_count").alias("n")).first()["n"] or 0
        first = self._ids("chunks", total)
        # one row a document: what a batch has of them bounds this window
        offsets = counts.select("document_id", (F.sum("chunk_count").over(Window.orderBy("document_id")) - F.col("chunk_count") + first).alias("offset"))
        new = given.join(F.broadcast(offsets), "document_id").withColumn("id", (F.col("offset") + F.col("ordinal")).cast("long"))
        counted = lexical.counted_terms(new.withColumn("body", text.lexical_text("heading_path", "text")), "id", "body").persist()
        postings, lengths = lexical.index_of(counted)
        done = ended.join(counts, F.col("document") == F.col("document_id"), "left").select("job", "document", F.col("title").alias("_title"), F.col("warnings").alias("_warnings"), F.col("error").alias("_error"), F.coalesce("chunk_count", F.lit(0).cast("long")).alias("_count")).persist()
        n = done.count()
        ends, now = F.col("_count").isNotNull(), F.current_timestamp()
        status = lambda good: F.when(ends & F.col("_error").isNull(), good).when(ends, "failed").otherwise(F.col("status"))
        common = lambda good: {"status": status(good), "error": F.when(ends, F.col("_error")).otherwise(F.col("error")), "updated_at": F.when(ends, now).otherwise(F.col("updated_at"))}
        filled = ends & F.col("_error").isNull()
        documents = self.table("documents", document_ranges).join(F.broadcast(done.withColumnRenamed("document", "id")), "id", "left").withColumns(
            common("ready") | {"title": F.when(filled, F.col("_title")).otherwise(F.col("title")), "warnings": F.when(filled, F.col("_warnings")).otherwise(F.col("warnings")), "chunk_count": F.when(filled, F.col("_count")).otherwise(F.col("chunk_count"))}
        )
        jobs = self.table("jobs", job_ranges).join(F.broadcast(done.withColumnRenamed("job", "id")), "id", "left").withColumns(common("succeeded"))
        index = {"chunks": new, "postings": postings, "lengths": lengths}
        changed = {"documents": (document_ranges, documents), "jobs": (job_ranges, jobs)}
        if ended.filter("error IS NULL AND had").isEmpty():
            self._commit(index, changed)
        else:
            gone = self.table("chunks").join(F.broadcast(sound), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
            left = {"chunks": self.table("chunks").join(sound, "document_id", "left_anti"), "postings": self.table("postings").join(gone, "chunk_id", "left_anti"), "lengths": self.table("lengths").join(gone, "chunk_id", "left_anti")}
            self._commit(None, changed, **{name: df.unionByName(index[name].select(df.columns)) for name, df in left.items()})
        for df in (outcomes, ended, given, counts, counted, done):
            df.unpersist()
        return n

    def reindex(self, collection: int) -> int:
        """Queues every document of an idle collection again and clears its index."""
        inside = F.col("collection_id") == collection
        docs = self.table("documents")
        if docs.filter(inside & F.col("status").isin("queued", "indexing")).count():
            raise StoreError("the collection is busy")
        mine = docs.filter(inside).select(F.col("id").alias("document_id"))
        dropped = self.table("chunks").filter(inside).select(F.col("id").alias("chunk_id"))
        now = F.current_timestamp()
        order, n = self._numbered("jobs", mine, "document_id")
        jobs = order.withColumnRenamed("number", "id").select("id", "document_id", F.lit("ingest").alias("kind"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"))
        self._commit(
            documents=self._set("documents", inside, status=F.lit("queued"), chunk_count=F.lit(0).cast("long")),
            added={"jobs": jobs},
            chunks=self.table("chunks").filter(~inside),
            postings=self.table("postings").join(dropped, "chunk_id", "left_anti"),
            lengths=self.table("lengths").join(dropped, "chunk_id", "left_anti"),
            collections=self.table("collections").withColumn("space_id", F.when(F.col("id") != collection, F.col("space_id"))),
        )
        return n

    # -- spaces

    def bind_space(self, collection: int, descriptor: Mapping) -> int:
        """The collection's embedding space: its first use binds it, an empty one
        follows the model, one with chunks of another model needs a reindex."""
        row = self._one(self.table("collections").filter(F.col("id") == collection), "collection")
        mark = space_fingerprint(descriptor)
        spaces = self.table("spaces")
        known = spaces.filter(F.col("fingerprint") == mark).collect()
        if known and row["space_id"] == known[0]["id"]:
            return row["space_id"]
        if row["space_id"] is not None and self.table("chunks").filter(F.col("collection_id") == collection).count():
            raise StoreError("the collection was indexed by another model: reindex it")
        if not 1 <= int(descriptor["dimensions"]) <= 8192:
            raise StoreError("1 to 8192 dimensions")
        key = known[0]["id"] if known else self._ids("spaces")
        if not known:
            new = self.spark.createDataFrame([(key, mark, descriptor["model_id"], int(descriptor["dimensions"]))], "id long, fingerprint string, model_id string, dimensions int")
            spaces = spaces.unionByName(new.withColumn("created_at", F.current_timestamp()))
        bound = self.table("collections").withColumn("space_id", F.when(F.col("id") == collection, F.lit(key)).otherwise(F.col("space_id")))
        self._commit(collections=bound, spaces=spaces.join(bound.select(F.col("space_id").alias("id")), "id", "left_semi"))
        return key

    def query_space(self, collection: int, descriptor: Mapping) -> bool:
        """Whether vectors of the model can be searched for in the collection: it must be bound to the
        model's space. False without chunks (nothing to find yet); another model's need a reindex."""
        row = self._one(self.table("collections").filter(F.col("id") == collection), "collection")
        if self.table("chunks").filter(F.col("collection_id") == collection).isEmpty():
            return False
        if row["space_id"] is None:
            return False
        if self._one(self.table("spaces").filter(F.col("id") == row["space_id"]), "space")["fingerprint"] != space_fingerprint(descriptor):
            raise StoreError("the collection was indexed by another model: reindex it")
        return True

    # -- index and copies

    def rebuild_lexical(self) -> None:
        chunks = self.table("chunks").withColumn("body", text.lexical_text("heading_path", "text"))
        counted = lexical.counted_terms(chunks, "id", "body").persist()
        postings, lengths = lexical.index_of(counted)
        self._manifest["lexical"] = LEXICAL_VERSION
        self._commit(postings=postings, lengths=lengths)
        counted.unpersist()

    def backup(self, target: str) -> "Store":
        """A consistent copy; the target must not hold anything."""
        copy = Store(self.spark, target)
        if copy._manifest["tables"]:
            raise StoreError("the target is not empty")
        copy._manifest["next"] = dict(self._manifest["next"])
        copy._commit(**{name: self.table(name) for name in self._manifest["tables"]})
        return copy

"""What the operators of this package share: checkpoints, sizes, column hygiene."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
SPACES = b" \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where
    the setting is absent and the session is local."""
    conf = spark.sparkContext.getConf()
    known = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if known:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(known)
        return known
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables that were settled and not yet released.
_settled: list[str] = []


def settled_so_far() -> int:
    return len(_settled)


def release_tables(spark: SparkSession, since: int, *more: str) -> None:
    """Deletes the tables that operators have settled since they were ``since``, and ``more`` folders:
    for a caller that has written all that it asked operators for in between."""
    for path in [*_settled[since:], *more]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _settled[since:]


def settle_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder. Unlike a checkpoint it
    carries nothing of the plan that made it: in loops the constraints that a checkpoint
    keeps of its columns double with every round."""
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _settled.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 250_000, weight: str | None = None) -> tuple[DataFrame, int]:
    """``df`` settled as a table, in no more partitions than its rows need (or its sum of
    ``weight``, ``rows`` of it a task), and how many rows it has. A small table then is
    one task's, and what follows on it needs no exchange; a large one keeps its partitions."""
    done = settle_table(df)
    have = done.agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.count("*")).alias("w")).first()
    return done.coalesce(max(1, -(-(have["w"] or 0) // rows))), have["n"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold ``rows`` rows where the session has Spark's default of
    10 000: with texts of many kilobytes both sides of every Python task would keep
    buffers of that many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under names of its own, so that
    further columns of any name cannot clash. A null text is an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def text_bytes(keyed: DataFrame) -> int:
    """Bytes of all texts: what numbers of groups and buckets are derived from."""
    return int(keyed.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)


def grouped_text(keyed: DataFrame, total: int, group_bytes: int) -> DataFrame:
    """Documents dealt by a hash of doc_id to groups of about ``group_bytes`` of
    text, so that every group fits in one Python worker at any input size. The
    hash ignores sources and contents: no hot key can fill a group."""
    groups = max(1, -(-total // group_bytes))
    parts = max(shuffle_partitions(keyed.sparkSession), groups // 16)
    return keyed.withColumn(
        "grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("long")
    ).repartition(parts, "grp")

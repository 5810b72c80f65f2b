"""Reading tables for work that takes more than reading does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold ``rows`` rows where the session has Spark's default of 10 000: with texts
    of many kilobytes both sides of every Python task would keep buffers, and what is made of them, of that many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` dealt by ``key`` to as many tasks as the session runs at once, if it has fewer: a file of one
    row group is one task, whatever is done with its rows. Larger tables stay as they are, unshuffled.
    Python tasks get them in small batches."""
    small_batches(scan.sparkSession)
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks, key) if scan.rdd.getNumPartitions() < tasks else scan

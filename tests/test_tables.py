"""Dealing the rows of small files."""

from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.sources import tables
from quarry.sources.tables import spread


def test_a_file_of_one_row_group_is_dealt_and_a_larger_table_is_not(spark, tmp_path):
    rows = spark.range(100).withColumn("t", F.concat(F.lit("t"), "id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(7).write.option("parquet.block.size", 1).parquet(str(tmp_path / "many"))
    tasks = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(one, "id")
    assert dealt.rdd.getNumPartitions() == tasks and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    many = spark.read.parquet(str(tmp_path / "many")).repartition(tasks + 3)
    assert spread(many, "id") is many
    assert spread(one.limit(0), "id").count() == 0


def test_python_tasks_get_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    for make in (lambda df: tables.spread(df, "id"), lambda df: chunking.chunk(df.select(F.col("id").alias("doc_id"), F.array().cast("array<struct<kind string, level int, text string>>").alias("blocks"), F.array().cast("array<int>").alias("pages"))) and df):
        spark.conf.set(name, "10000")
        assert make(spark.range(0, 9000, 1, 4)).select(size("id").alias("n")).agg(F.max("n")).first()[0] <= 1000
    spark.conf.set(name, "500")
    tables.small_batches(spark)
    assert spark.conf.get(name) == "500"
    spark.conf.set(name, "10000")

"""How long one exact search takes at a given size."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import random_vectors
from quarry.operators import dense, metrics

#: Fewer questions would make the 95th percentile the largest of a handful.
LEAST_QUESTIONS, MOST_QUESTIONS, WARM_UP = 20, 10_000, 3


@dataclass(frozen=True)
class Scale:
    vectors: int = 100_000
    dims: int = 1024
    questions: int = 50
    k: int = 50
    seed: int = 1
    target_ms: float = 250.0

    def __post_init__(self) -> None:
        if self.vectors < 1 or self.dims < 1 or self.k < 1:
            raise ValueError("vectors, dims and k must be positive")
        if not LEAST_QUESTIONS <= self.questions <= MOST_QUESTIONS:
            raise ValueError(f"questions must be {LEAST_QUESTIONS} to {MOST_QUESTIONS}")


def measure(spark: SparkSession, scale: Scale, path: str) -> DataFrame:
    """One row: random unit vectors are written to ``path``, then questions that follow them in the sequence are
    asked one at a time after a few to warm up. A search that returns fewer rows than it must is an error."""
    started = time.perf_counter()
    random_vectors(spark, scale.vectors, scale.dims, scale.seed).write.mode("errorifexists").parquet(path)
    written = time.perf_counter() - started
    vectors = spark.read.parquet(path)
    asked = random_vectors(spark, WARM_UP + scale.questions, scale.dims, scale.seed, scale.vectors, "qid").persist()
    took = []
    for q in range(WARM_UP + scale.questions):
        one = asked.filter(F.col("qid") == q)
        started = time.perf_counter()
        found = dense.knn(vectors, one, scale.k).toArrow().num_rows
        took.append((q, (time.perf_counter() - started) * 1000))
        if found != min(scale.k, scale.vectors):
            raise RuntimeError(f"a search returned {found} of {min(scale.k, scale.vectors)} rows")
    asked.unpersist()
    times = spark.createDataFrame(took[WARM_UP:], "q long, ms double")
    report = times.agg(F.count("*").alias("questions"), *(metrics.nearest_rank(p, "ms").alias(f"p{p}_ms") for p in (50, 95)), F.max("ms").alias("max_ms"))
    size = [F.lit(v).alias(c) for c, v in (("vectors", scale.vectors), ("dims", scale.dims), ("k", scale.k), ("written_s", round(written, 3)), ("target_ms", scale.target_ms))]
    return report.select(*size, "questions", "p50_ms", "p95_ms", "max_ms", (F.col("p95_ms") < scale.target_ms).alias("passed"))

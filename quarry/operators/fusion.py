"""Rank fusion, leader promotion, reranking and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

RRF_K = 60.0


def distinct_ranks(listed: DataFrame, id_col: str = "chunk_id", pos_col: str = "rank") -> DataFrame:
    """(qid, chunk_id, rank): positions among a list's distinct chunks."""
    first = listed.groupBy("qid", F.col(id_col).alias("chunk_id")).agg(F.min(pos_col).alias("p"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("p")).cast("long")).drop("p")


def fuse(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, chunk_id, lexical_rank, dense_rank, score, fused_rank) by reciprocal ranks."""
    lex = lexical.select("qid", "chunk_id", F.col("rank").alias("lexical_rank"))
    den = dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank"))
    part = lambda r: F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0))
    both = lex.join(den, ["qid", "chunk_id"], "full_outer").withColumn("score", F.round(part("lexical_rank") + part("dense_rank"), 12))
    return both.withColumn("fused_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")).cast("long"))


def promote_leaders(fused: DataFrame, per_list: int = 4) -> DataFrame:
    """With ``final_rank``: each list's first, then the rest of each list's best
    ``per_list``, then the others, in fused order within each."""
    best = F.least(F.col("lexical_rank"), F.col("dense_rank"))
    tier = F.when(best == 1, 0).when(best <= per_list, 1).otherwise(2)
    order = Window.partitionBy("qid").orderBy("tier", "fused_rank")
    return fused.withColumn("tier", tier).withColumn("final_rank", F.row_number().over(order).cast("long"))


def hydrate(ranked: DataFrame, chunks: DataFrame, k: int, rank_col: str = "final_rank") -> DataFrame:
    """The best ``k`` with their chunks: rows are fetched after the cut, not before."""
    top = ranked.filter(F.col(rank_col) <= k)
    return top.join(chunks, "chunk_id")


def term_overlap(question: str | Column, passage: str | Column) -> Column:
    """Share of the question's terms among the passage's words."""
    terms = text.query_terms(question)
    words = F.array_distinct(text.tokens(text.fold(passage)))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, words)) / F.size(terms))


def rerank(ranked: DataFrame, score_col: str, depth: int, pinned: int = 0, rank_col: str = "final_rank") -> DataFrame:
    """With ``rerank``: the first ``depth`` by score (leaders stay, NaN last, ties in
    their order), the tail as it was."""
    pos = F.col(rank_col)
    zone = F.when(pos <= pinned, 0).when(pos <= depth, 1).otherwise(2)
    score = F.when(zone == 1, F.col(score_col) + 0.0)
    order = Window.partitionBy("qid").orderBy(zone, F.coalesce(F.isnan(score), F.lit(False)), F.desc_nulls_last(score), pos)
    return ranked.withColumn("rerank", F.row_number().over(order).cast("long"))


def pack_context(candidates: DataFrame, budget: int, limit: int, cost_col: str = "cost", rank_col: str = "final_rank") -> DataFrame:
    """(qid, chosen, used, skipped): candidates in order, each taken if it still
    fits, until ``limit``; one that does not fit is passed over and counted."""
    listed = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), "chunk_id", F.col(cost_col).cast("long").alias("cost")))).alias("list"))
    start = F.struct(F.array().cast("array<bigint>").alias("chosen"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("skipped"))

    def step(s: Column, c: Column) -> Column:
        fits = s["used"] + c["cost"] <= budget
        took = F.struct(F.concat(s["chosen"], F.array(c["chunk_id"])).alias("chosen"), (s["used"] + c["cost"]).alias("used"), s["skipped"].alias("skipped"))
        passed = F.struct(s["chosen"].alias("chosen"), s["used"].alias("used"), (s["skipped"] + 1).alias("skipped"))
        return F.when(F.size(s["chosen"]) >= limit, s).when(fits, took).otherwise(passed)

    return listed.select("qid", F.aggregate("list", start, step).alias("s")).select("qid", "s.*")

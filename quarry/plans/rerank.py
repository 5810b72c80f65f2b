"""Reranking of fused candidates: windows of passages, scores, order.

All questions are reranked in one plan. A scorer sees whole Arrow batches of
(question, passage) pairs, as a model that runs in batches wants them; a question
with any pair that it fails on keeps its fused order, the others do not lose theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import answers
from quarry.functions.normalize import lexical_terms, words, normalize_for_lexical


@dataclass(frozen=True)
class Reranker:
    """``score`` gives a number to each of two equally long lists' (question, passage) pairs. The
    first ``depth`` candidates are scored, as windows of at most ``window`` characters
    if that is given; with ``pin_leaders`` what leads a list stays in front."""

    score: Callable[[list[str], list[str]], list[float]]
    depth: int = 16
    pin_leaders: bool = True
    window: int | None = None


def shared_terms(questions: list[str], passages: list[str]) -> list[float]:
    """The share of a question's terms that are words of the passage; 0 for a question without terms."""
    out = []
    for q, p in zip(questions, passages):
        terms, held = lexical_terms(q), set(words(normalize_for_lexical(p)))
        out.append(sum(t in held for t in terms) / len(terms) if terms else 0.0)
    return out


def windows(question: str | Column, passage: str | Column, most: int) -> Column:
    """The part of each passage that meets most of the question's terms; null if none meets any."""

    def cut(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([answers.passage_window(a or "", b or "", most) for a, b in zip(q, p)], dtype=object)

    return F.pandas_udf(cut, "string")(question, passage)


def leading(ranked: DataFrame, leaders: int) -> DataFrame:
    """With ``pinned``: whether this candidate and all before it are among the first ``leaders`` of a list."""
    leads = F.coalesce(F.least("lexical_rank", "dense_rank") <= leaders, F.lit(False))
    before = Window.partitionBy("qid").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("pinned", F.min(leads).over(before))


def rerank(ranked: DataFrame, questions: DataFrame, how: Reranker, leaders: int = 4) -> DataFrame:
    """``ranked`` (qid, chunk_id, final_rank, lexical_rank, dense_rank, text, ...) with ``rerank`` (the new
    position), ``rerank_score`` (null if not scored), ``whole`` (a scored passage that no window
    was found in) and ``fallback`` (the question keeps its order)."""

    def scored(q: pd.Series, p: pd.Series) -> pd.DataFrame:
        asked = q.notna()
        try:
            given = list(map(float, how.score(q[asked].tolist(), p[asked].tolist())))
            if len(given) != int(asked.sum()):
                raise ValueError("as many scores as passages are needed")
        except Exception:
            # pair by pair, so that only questions with a pair that fails keep their order
            given = [_alone(how.score, a, b) for a, b in zip(q[asked], p[asked])]
        out = pd.DataFrame({"score": pd.Series([None] * len(q), dtype=object), "failed": ~asked & False})
        out.loc[asked.to_numpy(), "score"] = pd.Series(given, index=out.index[asked.to_numpy()], dtype=object)
        out.loc[asked.to_numpy(), "failed"] = [x is None for x in given]
        return out.astype({"score": "object", "failed": "bool"})

    # a scored zone even of pinned leaders beyond the depth ends where they do
    rows = leading(ranked, leaders) if how.pin_leaders else ranked.withColumn("pinned", F.lit(False))
    rows = rows.join(questions.select("qid", "query"), "qid").withColumn("in_zone", ~F.col("pinned") & (F.col("final_rank") <= how.depth))
    cut = windows(F.when(F.col("in_zone"), F.col("query")), "text", how.window) if how.window else F.lit(None).cast("string")
    rows = rows.withColumn("cut", cut).withColumn("passage", F.coalesce("cut", "text"))
    given = F.pandas_udf(scored, "score double, failed boolean")(F.when(F.col("in_zone"), F.col("query")), "passage")
    rows = rows.withColumn("given", given)
    fallback = F.max(F.coalesce("given.failed", F.lit(False))).over(Window.partitionBy("qid"))
    rows = rows.withColumn("fallback", fallback).withColumn("rerank_score", F.when(F.col("in_zone") & ~F.col("fallback"), F.col("given.score") + 0.0))
    zone = F.when(F.col("pinned"), 0).when(F.col("in_zone"), 1).otherwise(2)
    place = F.when(~F.col("fallback"), zone).otherwise(0)
    order = Window.partitionBy("qid").orderBy(place, F.coalesce(F.isnan("rerank_score"), F.lit(False)), F.desc_nulls_last("rerank_score"), "final_rank")
    whole = F.lit(bool(how.window)) & F.col("in_zone") & F.col("cut").isNull()
    return rows.withColumn("rerank", F.row_number().over(order).cast("long")).withColumn("whole", whole).select(*ranked.columns, "rerank", "rerank_score", "whole", "fallback")


def _alone(score, question: str, passage: str) -> float | None:
    try:
        (value,) = score([question], [passage])
        return float(value)
    except Exception:
        return None

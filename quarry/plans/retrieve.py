"""Hybrid retrieval: questions to ranked chunks, all questions in one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dense, fusion, lexical
from quarry.operators.store import Store


@dataclass(frozen=True)
class RetrievalConfig:
    per_list: int = 50
    max_context: int = 8
    lexical: lexical.LexicalQuery = lexical.LexicalQuery(3, 7)

    @property
    def pool(self) -> int:
        """Candidates that the context is packed from."""
        return 2 * self.max_context


def retrieve(chunks: DataFrame, questions: DataFrame, strategy: str = "hybrid", config: RetrievalConfig = RetrievalConfig(), index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, chunk_id, score, lexical_rank, dense_rank, final_rank, excerpt, ...) of the pool.
    ``chunks``: chunk_id, text, embedding; ``questions``: qid, query, embedding. A
    lexical search reads no embeddings, so it outlives a change of model."""
    if strategy not in ("lexical", "dense", "hybrid"):
        raise ValueError(f"unknown strategy {strategy}")
    lex = den = None
    if strategy != "dense":
        lex = lexical.bm25(*index, questions, config.lexical, config.per_list) if index else lexical.search(chunks, questions, config.lexical, config.per_list)
    if strategy != "lexical":
        den = dense.knn(chunks.select("chunk_id", "embedding"), questions, config.per_list, "chunk_id")
    empty = (lex if den is None else den).select("qid", "chunk_id", "rank").limit(0)
    fused = fusion.fuse(empty if lex is None else lex, empty if den is None else den)
    ranked = fusion.promote_leaders(fused, config.max_context // 2)
    return fusion.hydrate(ranked, chunks.withColumn("excerpt", text.excerpt("text")), config.pool)


def search(store: Store, collection: int, questions: DataFrame, descriptor: Mapping | None = None, strategy: str = "hybrid", config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """What ``retrieve`` gives over a collection of a store, from its postings, lengths and vectors as
    they are stored. Term statistics cover all collections, results this one. Vectors of
    another model are an error; without vectors of the model there are no dense results."""
    if strategy not in ("lexical", "dense", "hybrid"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy != "lexical" and descriptor is None:
        raise ValueError("a dense search needs the descriptor of the questions' model")
    chunks = store.table("chunks").filter(F.col("collection_id") == collection).withColumnRenamed("id", "chunk_id")
    known = strategy != "lexical" and store.query_space(collection, descriptor)
    none = store.spark.createDataFrame([], "qid long, chunk_id long, rank long")
    lex, den = none, none
    if strategy != "dense":
        lex = lexical.bm25(store.table("postings"), store.table("lengths"), questions, config.lexical, config.per_list, chunks.select("chunk_id"))
    if known:
        den = dense.knn(chunks.select("chunk_id", "embedding"), questions, config.per_list, "chunk_id")
    ranked = fusion.promote_leaders(fusion.fuse(lex, den), config.max_context // 2)
    return fusion.hydrate(ranked, chunks.withColumn("excerpt", text.excerpt("text")), config.pool)

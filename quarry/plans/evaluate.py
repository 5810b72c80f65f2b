"""Evaluation of retrieval and of answers.

Every question of every strategy is one row of one plan: the lexical and the
dense lists are made once, and a run is known by (strategy, question). Reports are
one grouped pass over the rows, by strategy, category and split. Which questions miss
their evidence is a table, as are the ranks of each label; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import answers, text, vectors
from quarry.operators import chunking, dense, fusion, lexical, metrics
from quarry.operators.store import Store, StoreError
from quarry.plans import rerank as reranking
from quarry.plans.answer import Budget, select_context
from quarry.plans.retrieve import RetrievalConfig
from quarry.streaming import ingest

STRATEGIES = ("lexical", "dense", "hybrid")
#: Metrics look this deep, whatever the pool of the answer is.
DEPTH = 10
JUDGE_QUESTION = "Does the answer only state what the cited sources say? Answer YES or NO."


# --- the corpus ----------------------------------------------------------------------


def _same_content(files: DataFrame) -> None:
    twice = files.groupBy("sha256").agg(F.min("name").alias("first"), F.max("name").alias("last"), F.count("*").alias("n")).filter("n > 1").orderBy("first").first()
    if twice:
        raise StoreError(f"{twice['last']} has the same content as {twice['first']}: labels can name one of them only")


def index_corpus(store: Store, collection: int, files: DataFrame, config: chunking.ChunkerConfig = chunking.ChunkerConfig(), embed=vectors.fake_embedding) -> int:
    """Indexes ``files`` (``formats.corpus``) and returns how many there are. What would only score
    0 is an error: two files of one content, a file that cannot be read."""
    _same_content(files)
    store.enqueue(collection, files.select(F.col("name").alias("filename"), F.col("kind").alias("format"), "content"))
    ingest.work(store, config, embed)
    inside = store.table("documents").filter(F.col("collection_id") == collection)
    failed = inside.filter("status = 'failed'").orderBy("filename").first()
    if failed:
        raise StoreError(f"{failed['filename']}: {failed['error']}")
    return inside.count()


def check_index(store: Store, collection: int, files: DataFrame) -> int:
    """How many documents an index that is used again holds: exactly the contents of ``files``, all ready, or it is an error."""
    _same_content(files)
    inside = store.table("documents").filter(F.col("collection_id") == collection)
    waiting = inside.filter("status != 'ready'").orderBy("filename").first()
    if waiting:
        raise StoreError(f"{waiting['filename']} is not ready")
    both = files.select("sha256", F.lit(1).alias("f")).join(inside.select("sha256", F.lit(1).alias("d")), "sha256", "full_outer")
    n = both.agg(F.count("f").alias("files"), F.count("d").alias("indexed"), F.count(F.col("f") + F.col("d")).alias("common")).first()
    if not n["files"] == n["indexed"] == n["common"]:
        raise StoreError(f"the corpus is not what was indexed: {n['files']} files, {n['indexed']} indexed, {n['common']} in common")
    return n["indexed"]


# --- retrieval -------------------------------------------------------------------------


def _runs(df: DataFrame, strategies: list[str]) -> DataFrame:
    """A copy for each strategy, told apart by the question's key."""
    keys = [F.struct(F.lit(s).alias("strategy"), F.col("qid").alias("id")) for s in strategies]
    return df.withColumn("qid", F.explode(F.array(*keys))) if keys else df.limit(0).withColumn("qid", F.struct(F.lit("").alias("strategy"), F.col("qid").alias("id")))


def evaluate_retrieval(
    chunks: DataFrame,
    questions: DataFrame,
    labels: DataFrame,
    strategies: tuple[str, ...] = STRATEGIES,
    config: RetrievalConfig = RetrievalConfig(),
    index: tuple[DataFrame, DataFrame] | None = None,
    budget: Budget | None = None,
    reranker: reranking.Reranker | None = None,
    rank_depth: int = DEPTH,
) -> DataFrame:
    """One row per strategy and question: its metrics, ``ranks`` of its labels, whether the evidence is ``in_context``
    and how many candidates were ``skipped``. ``chunks``: chunk_id, document, text, embedding (with a
    ``budget`` also title, filename, heading_path); ``questions``: qid, query, embedding, require_all, category,
    split; ``labels``: qid, label, document, contains. The context is what an answer would see: the first chunks of
    the pool, or those that fit ``budget``. A reranker orders hybrid candidates only."""
    if not set(strategies) <= set(STRATEGIES) or not strategies:
        raise ValueError(f"strategies are {', '.join(STRATEGIES)}")
    if not 0 < rank_depth <= config.per_list:
        raise ValueError(f"rank_depth must be 1 to {config.per_list}")
    lex = lexical.bm25(*index, questions, config.lexical, config.per_list) if index else lexical.search(chunks, questions, config.lexical, config.per_list)
    den = dense.knn(chunks.select("chunk_id", "embedding"), questions, config.per_list, "chunk_id")
    fused = fusion.fuse(_runs(lex, [s for s in strategies if s != "dense"]), _runs(den, [s for s in strategies if s != "lexical"]))
    leaders = config.max_context // 2
    shown = chunks.drop("embedding")
    top = fusion.hydrate(fusion.promote_leaders(fused, leaders), shown, max(DEPTH, config.pool, rank_depth))
    asked = _runs(questions.drop("embedding"), list(strategies))
    if reranker:
        hybrid = F.col("qid.strategy") == "hybrid"
        again = reranking.rerank(top.filter(hybrid), asked, reranker, leaders)
        top = top.filter(~hybrid).unionByName(again.withColumn("final_rank", F.col("rerank")).select(*top.columns))
    wanted = _runs(labels, list(strategies))
    ranks = metrics.label_ranks(top.withColumnRenamed("final_rank", "rank"), wanted)
    listed = ranks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("label", "rank"))).alias("l"))
    scores = metrics.question_scores(ranks, asked.drop("query"), config.max_context).join(listed.select("qid", F.col("l.rank").alias("ranks")), "qid", "left")
    skipped = F.lit(0).cast("long")
    if budget:
        contexts = select_context(asked, top.filter(F.col("final_rank") <= config.pool), budget)
        told = contexts.select("qid", F.explode("sources").alias("s")).select("qid", F.col("s.number").alias("rank"), F.col("s.chunk_id").alias("chunk_id"))
        prompt = metrics.label_ranks(told.join(shown, "chunk_id"), wanted)
        inside = metrics.question_scores(prompt, asked.select("qid", "require_all"), config.max_context).select("qid", "in_context")
        scores = scores.drop("in_context").join(inside, "qid").join(contexts.select("qid", "skipped"), "qid", "left")
        skipped = F.coalesce("skipped", skipped)
    return scores.select(
        F.col("qid.strategy").alias("strategy"), F.col("qid.id").alias("qid"), "category", "split", "require_all", "found_at_5", "found_at_10", "in_context", "reciprocal_rank", "ndcg",
        F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks"), skipped.alias("skipped"),
    )


def retrieval_report(scores: DataFrame, places: int = 6) -> DataFrame:
    """Means of ``evaluate_retrieval`` by strategy, overall and per category and split, with how many questions
    miss their evidence and how many candidates were skipped."""
    return metrics.group_means(scores, places, by=["strategy"])


def missed_in_context(scores: DataFrame) -> DataFrame:
    """(strategy, qid, category, split) of the questions whose evidence an answer would not see."""
    return scores.filter(~F.col("in_context")).select("strategy", "qid", "category", "split")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(strategy, qid, was, now): questions whose evidence entered or left the context between two runs."""
    side = lambda df, name: df.select("strategy", "qid", F.col("in_context").alias(name))
    return side(before, "was").join(side(after, "now"), ["strategy", "qid"]).filter("was != now")


# --- answers -------------------------------------------------------------------------------


def _evidence(cited: pd.Series, expect: pd.Series) -> pd.Series:
    out = []
    for texts, wanted in zip(cited, expect):
        hay = [answers.normalized(t) for t in (texts if texts is not None else [])]
        terms = [answers.normalized(t) for e in (wanted if wanted is not None else []) for t in e.split("|")]
        out.append(any(answers.contains_term(h, t) for h in hay for t in terms))
    return pd.Series(out, dtype=bool)


def holds_evidence(cited: str | Column, expect: str | Column) -> Column:
    """Whether any of the texts holds any alternative of any expected text, as terms."""
    return F.pandas_udf(_evidence, "boolean")(cited, expect)


def evaluate_answers(probes: DataFrame, answered: DataFrame, judge: Callable[[str], str] | None = None) -> DataFrame:
    """One row per probe with what ``metrics`` asks for. ``probes``: qid, expect, answerable, category, split;
    ``answered``: rows of ``plans.answer``. ``judge``, if given, is asked whether an answer of an answerable
    probe that cites something keeps to its sources; its first word counts."""
    both = probes.join(answered, "qid")
    cited = F.filter(F.coalesce("sources", F.array().cast(answered.schema["sources"].dataType)), lambda s: F.array_contains("citations", s["number"]))
    found = answers.facts("answer", "expect", "abstained")
    rows = both.withColumn("cited", F.array_sort(F.transform(cited, lambda s: F.struct(s["number"].alias("number"), s["text"].alias("text"))))).withColumn("found_facts", found)
    given = F.col("answerable") & ~F.col("abstained")
    verdict = F.lit(None).cast("boolean")
    if judge:
        sources = F.array_join(F.transform("cited", lambda s: F.concat(F.lit("["), s["number"].cast("string"), F.lit("]\n"), s["text"])), "\n\n")
        prompt = F.concat(F.lit("Sources:\n"), sources, F.lit("\n\nAnswer:\n"), "answer", F.lit(f"\n\n{JUDGE_QUESTION}"))
        reply = F.pandas_udf(lambda p: p.map(judge, na_action="ignore"), "string")(F.when(given & (F.size("cited") > 0), prompt))
        rows = rows.withColumn("reply", reply)
        verdict = text.judge_verdict("reply")
    return rows.select(
        "qid", "category", "split", "answerable", "abstained", "uncited", "finish_reason", "found_facts",
        F.size("found_facts").cast("long").alias("found"), F.size("expect").cast("long").alias("expected"),
        ((F.size("citations") > 0) & (F.size("invalid_citations") == 0)).alias("valid_citations"),
        (given & holds_evidence(F.col("cited.text"), "expect")).alias("cited_evidence"),
        verdict.alias("verdict"), text.distinct_line_ratio(F.coalesce("answer", F.lit(""))).alias("distinct_line_ratio"),
    )


def answer_report(outcomes: DataFrame) -> DataFrame:
    """Metrics of ``evaluate_answers`` in one pass: overall, and per category and split of the probes that have one."""
    keys = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("overall", F.lit("all")), ("category", F.col("category")), ("split", F.col("split"))))), lambda s: s["key"].isNotNull())
    return metrics.answer_summary(outcomes.withColumn("k", F.explode(keys)).select("*", "k.kind", "k.key").drop("k"), ["kind", "key"])

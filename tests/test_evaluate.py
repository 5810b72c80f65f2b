"""Evaluation of retrieval and answers on a small corpus, against the rules applied row by row."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import answers
from quarry.operators import chunking, metrics
from quarry.operators.lexical import LexicalQuery
from quarry.operators.store import Store, StoreError
from quarry.plans import catalogue, evaluate, rerank
from quarry.plans.answer import Budget, answer, select_context
from quarry.plans.retrieve import RetrievalConfig, retrieve
from quarry.sources import formats

CHUNKS = "chunk_id long, document string, title string, filename string, heading_path array<string>, text string, embedding array<float>"
QUESTIONS = "qid long, query string, embedding array<float>, require_all boolean, category string, split string"
LABELS = "qid long, label long, document string, contains string"
TOPICS = ["refund period of fourteen days", "night shift pay is extra", "parcel tracking number online", "annual leave of twenty days", "warranty covers two years"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for k in range(40):
        topic = TOPICS[k % 5]
        v = [1.0 if j == k % 5 else 0.1 * ((k + j) % 3) for j in range(6)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((k, f"d{k % 5}.md", f"T{k % 5}", f"d{k % 5}.md", [f"T{k % 5}", f"S{k}"], f"{topic} note {k}  and  more words {k * 7 % 11}", [x / n for x in v]))
    asked = []
    for q in range(8):
        v = [1.0 if j == (q + q // 5) % 5 else 0.0 for j in range(6)]
        asked.append((q, f"what about {TOPICS[q % 5]} note {q}", v, q == 3, "factual" if q % 2 else None, "dev" if q < 4 else "holdout"))
    labels = [(q, 0, f"d{q % 5}.md", f"note {q} and") for q in range(8)] + [(3, 1, "d3.md", "note 13 and"), (6, 1, "d0.md", "nowhere to be found")]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, QUESTIONS), spark.createDataFrame(labels, LABELS)


def by_hand(corpus, strategy, config):
    """Each question's metrics from the candidates that a search gives, one label at a time."""
    chunks, questions, labels = corpus
    found = {}
    for r in retrieve(chunks, questions, strategy, config).collect():
        found.setdefault(r["qid"], {})[r["final_rank"]] = (r["document"], " ".join(r["text"].split()))
    wanted = {}
    for r in labels.orderBy("qid", "label").collect():
        wanted.setdefault(r["qid"], []).append((r["document"], r["contains"]))
    out = {}
    for q in questions.collect():
        listed = found.get(q["qid"], {})
        ranks = [min((k for k, (d, t) in listed.items() if d == document and text in t), default=None) for document, text in wanted[q["qid"]]]
        every = q["require_all"]
        hit = lambda k: (all if every else any)(r is not None and r <= k for r in ranks)
        known = [r for r in ranks if r]
        at = (max(known) if len(known) == len(ranks) else None) if every else min(known, default=None)
        at = at if at and at <= 10 else None
        if every:
            places = [max(r, j) for j, r in enumerate(sorted(known), 1)]
            ndcg = sum(1 / math.log2(p + 1) for p in places if p <= 10) / sum(1 / math.log2(j + 1) for j in range(1, min(len(ranks), 10) + 1))
        else:
            ndcg = 1 / math.log2(at + 1) if at else 0.0
        out[q["qid"]] = (ranks, hit(5), hit(10), hit(config.max_context), round(1 / at if at else 0.0, 9), round(ndcg, 9))
    return out


def test_retrieval_is_scored_for_all_strategies_at_once(spark, corpus):
    config = RetrievalConfig(per_list=20, max_context=4, lexical=LexicalQuery())
    scores = evaluate.evaluate_retrieval(*corpus, config=config).persist()
    got = {(r["strategy"], r["qid"]): (list(r["ranks"]), r["found_at_5"], r["found_at_10"], r["in_context"], round(r["reciprocal_rank"], 9), round(r["ndcg"], 9)) for r in scores.collect()}
    config_deep = RetrievalConfig(per_list=20, max_context=4, lexical=LexicalQuery())
    for strategy in evaluate.STRATEGIES:
        for qid, row in by_hand(corpus, strategy, config_deep).items():
            mine = got[strategy, qid]
            # retrieve() gives the pool of 8, the evaluation looks 10 deep
            assert [r if r and r <= 8 else None for r in mine[0]] == row[0]
            assert mine[1] == row[1] and mine[3] == row[3]
    report = {(r["strategy"], r["kind"], r["key"]): r for r in evaluate.retrieval_report(scores).collect()}
    assert set(report) == {(s, k, v) for s in evaluate.STRATEGIES for k, v in (("overall", "all"), ("category", "factual"), ("category", "uncategorized"), ("split", "dev"), ("split", "holdout"))}
    for s in evaluate.STRATEGIES:
        rows = [v for (strategy, _), v in got.items() if strategy == s]
        assert report[s, "overall", "all"]["queries"] == 8 and report[s, "overall", "all"]["missed"] == sum(not r[3] for r in rows)
        assert abs(report[s, "overall", "all"]["mrr_at_10"] - sum(r[4] for r in rows) / 8) < 1e-6
    missed = {(r["strategy"], r["qid"]) for r in evaluate.missed_in_context(scores).collect()}
    assert missed == {k for k, v in got.items() if not v[3]}
    assert evaluate.compare(scores, scores).count() == 0


def test_whole_metrics_by_hand_where_the_pool_is_deep(corpus):
    config = RetrievalConfig(per_list=20, max_context=5, lexical=LexicalQuery())
    got = evaluate.evaluate_retrieval(*corpus, strategies=("hybrid",), config=config).collect()
    want = by_hand(corpus, "hybrid", config)
    assert {r["qid"]: (list(r["ranks"]), r["found_at_5"], r["found_at_10"], r["in_context"], round(r["reciprocal_rank"], 9), round(r["ndcg"], 9)) for r in got} == want


def test_a_budget_decides_what_is_in_the_context(corpus):
    chunks, questions, labels = corpus
    config = RetrievalConfig(per_list=20, max_context=4, lexical=LexicalQuery())
    free = {r["qid"]: r for r in evaluate.evaluate_retrieval(chunks, questions, labels, ("lexical",), config, budget=Budget(8192, 1024, 4)).collect()}
    plain = {r["qid"]: r for r in evaluate.evaluate_retrieval(chunks, questions, labels, ("lexical",), config).collect()}
    assert {q: r["in_context"] for q, r in free.items()} == {q: r["in_context"] for q, r in plain.items()} and not any(r["skipped"] for r in free.values())
    none = evaluate.evaluate_retrieval(chunks, questions, labels, ("lexical",), config, budget=Budget(40, 10, 4)).collect()
    assert len(none) == 8 and not any(r["in_context"] for r in none)
    assert {r["qid"]: r["found_at_5"] for r in none} == {q: r["found_at_5"] for q, r in plain.items()}
    first = retrieve(chunks, questions, "lexical", config).withColumn("text", F.when(F.col("final_rank") == 1, F.repeat(F.lit("long "), 9000)).otherwise(F.col("text")))
    assert select_context(questions, first, Budget(8192, 1024, 4)).agg(F.min("skipped")).first()[0] == 1


def test_arguments(corpus):
    with pytest.raises(ValueError):
        evaluate.evaluate_retrieval(*corpus, strategies=("other",))
    with pytest.raises(ValueError):
        evaluate.evaluate_retrieval(*corpus, rank_depth=51)


# --- reranking ---------------------------------------------------------------------------


RANKED = "qid long, chunk_id long, final_rank long, lexical_rank long, dense_rank long, text string"


def reranked(spark, rows, how, leaders=1):
    questions = spark.createDataFrame(sorted({(r[0], f"question {r[0]} apples") for r in rows}), "qid long, query string")
    got = rerank.rerank(spark.createDataFrame(rows, RANKED), questions, how, leaders).collect()
    order = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rerank"])):
        order.setdefault(r["qid"], []).append(r["chunk_id"])
    return order, got


def test_leaders_stay_the_zone_is_ordered_the_tail_is_not(spark):
    score = lambda qs, ps: [float(p.split()[-1]) for p in ps]
    rows = [(1, 10, 1, 1, 9, "a 0"), (1, 11, 2, None, 1, "b 0"), (1, 12, 3, 5, 5, "c 1"), (1, 13, 4, 6, 4, "d 7"), (1, 14, 5, 1, None, "e 7"), (1, 15, 6, 8, 8, "f nan"), (1, 16, 7, 9, 9, "g 99")]
    assert reranked(spark, rows, rerank.Reranker(score, depth=6))[0][1] == [10, 11, 13, 14, 12, 15, 16]
    # without pins, and negative zero ties with zero
    rows[0] = (1, 10, 1, 1, 9, "a -0.0")
    assert reranked(spark, rows, rerank.Reranker(score, depth=6, pin_leaders=False))[0][1] == [13, 14, 12, 10, 11, 15, 16]
    assert reranked(spark, rows, rerank.Reranker(score, depth=1))[0][1] == [10, 11, 12, 13, 14, 15, 16]


def test_a_question_whose_scorer_fails_keeps_its_order(spark):
    def score(questions, passages):
        if any("bad" in p for p in passages):
            raise RuntimeError("no")
        return [float(len(p)) for p in passages]

    rows = [(1, 10, 1, None, None, "x"), (1, 11, 2, None, None, "bad"), (1, 12, 3, None, None, "xxx"), (2, 20, 1, None, None, "y"), (2, 21, 2, None, None, "yyy")]
    order, got = reranked(spark, rows, rerank.Reranker(score))
    assert order == {1: [10, 11, 12], 2: [21, 20]}
    assert {r["qid"]: r["fallback"] for r in got} == {1: True, 2: False} and all(r["rerank_score"] is None for r in got if r["qid"] == 1)
    order, got = reranked(spark, rows[3:], rerank.Reranker(lambda q, p: [1.0]))
    assert order == {2: [20, 21]} and all(r["fallback"] for r in got) is False


def test_windows(spark):
    filler = "Nothing of the kind. " * 30
    seen = []

    def score(questions, passages):
        seen.extend(passages)
        return [float("apples" in p and len(p) <= 80) for p in passages]

    rows = [(1, 10, 1, None, None, filler), (1, 11, 2, None, None, filler + "Here are apples. " + filler)]
    order, got = reranked(spark, rows, rerank.Reranker(score, window=80))
    assert order == {1: [11, 10]}
    assert {r["chunk_id"]: r["whole"] for r in got} == {10: True, 11: False}
    assert answers.passage_window("question 1 apples", rows[1][5], 80).strip().find("apples") >= 0


def test_a_reranker_changes_hybrid_runs_only(corpus):
    config = RetrievalConfig(per_list=20, max_context=4, lexical=LexicalQuery())
    plain = {(r["strategy"], r["qid"]): list(r["ranks"]) for r in evaluate.evaluate_retrieval(*corpus, config=config).collect()}
    again = {(r["strategy"], r["qid"]): list(r["ranks"]) for r in evaluate.evaluate_retrieval(*corpus, config=config, reranker=rerank.Reranker(rerank.shared_terms, 8, False)).collect()}
    assert {k for k in plain if plain[k] != again[k]} <= {k for k in plain if k[0] == "hybrid"}
    best = [min((x for x in again["hybrid", q] if x), default=99) for q in range(8)]
    assert sum(b <= 3 for b in best) >= 6


# --- answers ---------------------------------------------------------------------------------


def test_answers_are_scored_and_reported(spark):
    questions = spark.createDataFrame([(1, "how long is the refund period?"), (2, "what is the pay?"), (3, "who knows?"), (4, "silent?"), (5, "loop?")], "qid long, query string")
    text = ["The refund period is fourteen (14) days.", "Extra pay is 18 TL for a night shift."]
    rows = [(q, 10 * q + k, k + 1, "T", "t.md", ["T"], t) for q in (1, 2, 3, 5) for k, t in enumerate(text)]
    contexts = select_context(questions, spark.createDataFrame(rows, "qid long, chunk_id long, final_rank long, title string, filename string, heading_path array<string>, text string"))
    replies = {"how long": ("It is 14 days [1].", "stop"), "what is": ("18 TL, I think [2] [7].", "length"), "who knows": (answers.REFUSAL_EN, "stop"), "loop": ("a line that goes on\n" * 4, "stop")}
    said = answer(contexts, lambda system, user: next(v for k, v in replies.items() if k in user)).persist()
    probes = spark.createDataFrame(
        [(1, ["14 days|fourteen days", "refund"], True, "factual", "dev"), (2, ["18 TL"], True, None, "dev"), (3, [], False, "unanswerable", "holdout"), (4, ["x"], True, "factual", None), (5, ["line"], True, None, "dev")],
        "qid long, expect array<string>, answerable boolean, category string, split string",
    )
    outcomes = evaluate.evaluate_answers(probes, said, judge=lambda prompt: "**Yes**" if "[1]\n" in prompt and "fourteen" in prompt else "no")
    got = {r["qid"]: r for r in outcomes.collect()}
    assert got[1]["found_facts"] == [0] and got[1]["expected"] == 2 and got[1]["valid_citations"] and got[1]["cited_evidence"] and got[1]["verdict"]
    assert got[2]["found"] == 1 and not got[2]["valid_citations"] and got[2]["cited_evidence"] and got[2]["verdict"] is False
    assert got[3]["abstained"] and not got[3]["cited_evidence"] and got[3]["verdict"] is None
    assert got[4]["abstained"] and got[4]["found"] == 0
    assert got[5]["uncited"] and got[5]["finish_reason"] == "repetition" and got[5]["distinct_line_ratio"] == 0.25
    report = {(r["kind"], r["key"]): r for r in evaluate.answer_report(outcomes).collect()}
    assert set(report) == {("overall", "all"), ("category", "factual"), ("category", "unanswerable"), ("split", "dev"), ("split", "holdout")}
    overall = report["overall", "all"]
    assert (overall["probes"], overall["complete"], overall["refused_answerable"], overall["refused_unanswerable"], overall["judge_yes_rate"]) == (5, 2, 1, 1, 0.5)
    assert (overall["true_positive"], overall["false_positive"], overall["precision"], overall["recall"]) == (1, 1, 0.5, 1.0)
    assert report["split", "holdout"]["coverage"] is None and report["split", "dev"]["finish_length"] == 1


def test_evidence_is_found_as_terms(spark):
    df = spark.createDataFrame([(["The fee is 118 TL."], ["18 TL"]), (["The fee is 18 tl."], ["x|18 TL"]), ([], ["a"]), (None, ["a"]), (["a b"], [])], "c array<string>, e array<string>")
    assert [r[0] for r in df.select(evaluate.holds_evidence("c", "e")).collect()] == [False, True, False, False, False]


# --- the corpus --------------------------------------------------------------------------------


def test_a_corpus_is_indexed_once_and_known_again(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("# Refund\n\nFourteen days to send it back.")
    (folder / "b.txt").write_text("Night shifts are paid extra.")
    store = Store(spark, str(tmp_path / "store"))
    key = store.create_collection("docs")
    files = formats.corpus(spark, str(folder))
    assert evaluate.index_corpus(store, key, files, chunking.ChunkerConfig(20, 30, 4)) == 2
    assert evaluate.check_index(store, key, formats.corpus(spark, str(folder))) == 2
    (folder / "c.txt").write_text("A third one.")
    with pytest.raises(StoreError, match="3 files, 2 indexed, 2 in common"):
        evaluate.check_index(store, key, formats.corpus(spark, str(folder)))
    (folder / "d.txt").write_text("A third one.")
    with pytest.raises(StoreError, match="same content"):
        evaluate.check_index(store, key, formats.corpus(spark, str(folder)))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.txt").write_bytes(b"\xff\xfe\x00")
    with pytest.raises(StoreError, match="x.txt"):
        evaluate.index_corpus(store, store.create_collection("more"), formats.corpus(spark, str(bad)))


def test_nearest_ranks_of_few_groups_are_exact(spark):
    rows = [(g, float((i * i * 7919) % 1013) if i % 5 else 3.0) for g, n in (("a", 3000), ("b", 1), ("c", 40), (None, 777)) for i in range(n)] + [("c", float("nan")), ("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = metrics.nearest_ranks(df, "g", "v", {"p0": 0, "p50": 50, "p95": 95, "p100": 100})
    one = df.groupBy("g").agg(F.count("v").alias("n"), *(metrics.nearest_rank(p, "v").alias(f"p{p}") for p in (0, 50, 95, 100)))
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(got) == shown(one)
    # no aggregate holds all values of a group
    assert "percentiledisc" not in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    query = catalogue.QUERIES["percentile_nearest_rank"](spark, "/root/testdata/sf0.001")
    assert "percentile_disc" not in query._jdf.queryExecution().optimizedPlan().toString().lower()

"""Fusion, search and metrics on literal values; every query against DuckDB."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.operators import dense, fusion, lexical, metrics
from quarry.plans import catalogue
from quarry.plans.retrieve import retrieve

SF = "/root/testdata/sf0.001"


def lists(spark, lexical, den):
    frame = lambda ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "qid long, chunk_id long, rank long")
    return fusion.fuse(frame(lexical), frame(den))


def order(df, col):
    return [r["chunk_id"] for r in df.orderBy(col).collect()]


def test_fusion_goldens(spark):
    fused = lists(spark, [9, 1, 2, 3], [4, 1, 2, 3])
    assert order(fused, "fused_rank") == [1, 2, 3, 4, 9]
    assert order(fusion.promote_leaders(fused, 1), "final_rank") == [4, 9, 1, 2, 3]
    assert lists(spark, [], []).count() == 0
    twice = fusion.distinct_ranks(spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "qid long, chunk_id long, rank long"))
    assert {r["chunk_id"]: r["rank"] for r in twice.collect()} == {5: 1, 6: 2}


def test_rerank_puts_nan_last(spark):
    rows = [(1, i, i, s) for i, s in enumerate([0.1, float("nan"), 0.9, float("-inf"), 0.9], 1)]
    got = fusion.rerank(spark.createDataFrame(rows, "qid long, chunk_id long, final_rank long, s double"), "s", 5)
    assert order(got, "rerank") == [3, 5, 1, 4, 2]


def test_context_skips_what_does_not_fit(spark):
    rows = [(1, c, i, cost) for i, (c, cost) in enumerate([(7, 60), (8, 50), (9, 30), (4, 5)], 1)]
    got = fusion.pack_context(spark.createDataFrame(rows, "qid long, chunk_id long, final_rank long, cost long"), 100, 3).first()
    assert (got["chosen"], got["used"], got["skipped"]) == ([7, 9, 4], 95, 1)


def test_knn(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [0.9, 0.1, 0.0, 0.0])], "qid long, embedding array<float>")
    got = dense.knn(vecs, asked, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3] and got[0]["cosine"] == pytest.approx(0.9 / math.sqrt(0.82), abs=1e-6)
    assert dense.knn(vecs, asked.limit(0), 2).count() == 0 and dense.knn(vecs.limit(0), asked, 2).count() == 0
    with pytest.raises(ValueError):
        dense.knn(vecs, asked, 5000)


def test_scores(spark):
    ranks = spark.createDataFrame([(1, 0, 2), (1, 1, None), (2, 0, 1), (2, 1, 12), (3, 0, None)], "qid long, label long, rank long")
    questions = spark.createDataFrame([(1, False, "a", None), (2, True, None, "dev"), (3, False, "a", "dev"), (4, False, "a", "dev")], "qid long, require_all boolean, category string, split string")
    got = {r["qid"]: r for r in metrics.question_scores(ranks, questions).collect()}
    assert got[1]["reciprocal_rank"] == 0.5 and got[1]["ndcg"] == pytest.approx(1 / math.log2(3)) and got[1]["found_at_5"]
    assert not got[2]["found_at_10"] and got[2]["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3))) and got[2]["reciprocal_rank"] == 0
    assert got[3]["ndcg"] == 0 and got[4]["found_at_10"] is False
    means = {(r["kind"], r["key"]): r["queries"] for r in metrics.group_means(metrics.question_scores(ranks, questions)).collect()}
    assert means == {("overall", "all"): 4, ("category", "a"): 3, ("category", "uncategorized"): 1, ("split", "dev"): 3, ("split", "unsplit"): 1}


def test_rates_over_nothing_are_null(spark):
    none = spark.createDataFrame([(True, False)], "answerable boolean, abstained boolean")
    got = metrics.confusion(none).first()
    assert got["true_negative"] == 1 and got["precision"] is None and got["recall"] is None


def test_strategies(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "gamma", [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "alpha", [0.0, 1.0])], "qid long, query string, embedding array<float>")
    first = lambda s: retrieve(chunks, asked, s).orderBy("final_rank").first()["chunk_id"]
    assert first("lexical") == 1 and first("dense") == 2 and retrieve(chunks, asked).count() == 2
    with pytest.raises(ValueError):
        retrieve(chunks, asked, "other")


def _values(rows):
    def one(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9)
        return str(v) if isinstance(v, list) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _values(df.select(columns).collect())
    if name in catalogue.ORACLES:
        expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert got == _values(expected)
    else:
        assert got


def test_top_50_of_every_asked_id(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    got = catalogue.QUERIES["knn_batch_top50"](spark, SF).groupBy("qid").count().collect()
    assert len(got) == asked > 1 and all(r["count"] == 50 for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_html_forms_agree(spark):
    both = catalogue.QUERIES["html_to_text"](spark, SF).join(catalogue.QUERIES["html_to_text_exact"](spark, SF).withColumnRenamed("visible", "exact"), "page_id")
    same = both.agg(F.avg((F.col("visible") == F.col("exact")).cast("double")).alias("a")).first()["a"]
    assert same > 0.9


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_with_ties_equals_all_products_sorted(spark, monkeypatch, block):
    import numpy as np

    rng = np.random.default_rng(3)
    # few directions, so that many cosines tie and the cut falls among them
    points = rng.integers(-1, 2, (300, 3)).astype(float)
    points[(points == 0).all(1)] = 1.0
    vecs = spark.createDataFrame([(int(k) * 7 % 301, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points[:40])], "qid long, embedding array<float>")
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "PRODUCT", 2048)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    cosine, ids = np.round(unit[:40] @ unit.T, 6), np.arange(300) * 7 % 301
    want = [(q, int(ids[v]), float(cosine[q, v]), n) for q in range(40) for n, v in enumerate(np.lexsort((ids, -cosine[q]))[:9], 1)]
    assert sorted(tuple(r) for r in dense.knn(vecs, asked, 9).collect()) == sorted(want)


def test_questions_beyond_a_block_do_not_pass_through_the_driver(spark, monkeypatch):
    vecs = spark.range(50).selectExpr("id AS vec_id", "array(cast(1 AS float), cast(id AS float)) AS embedding")
    monkeypatch.setattr(dense, "BLOCK", 10)
    found = dense.knn(vecs, vecs.withColumnRenamed("vec_id", "qid"), 3)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "MapInArrow" in plan and found.count() == 150


@pytest.mark.parametrize("dims", [2, 3, 64])
def test_random_vectors_are_the_sequence_wherever_they_are_drawn(spark, dims):
    import numpy as np

    from quarry.functions import vectors

    whole = vectors.unit_vectors(300, dims, 9)
    assert np.array_equal(vectors.unit_rows(0, 300, dims, 9), whole)
    assert np.array_equal(vectors.unit_rows(123, 45, dims, 9), whole[123:168])
    got = vectors.random_vectors(spark, 200, dims, 9, first=100).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(200))
    assert np.array_equal(np.array([r["embedding"] for r in got], np.float32), whole[100:])


def test_a_scale_is_measured(spark, tmp_path):
    from quarry.plans.scale import Scale, measure

    got = measure(spark, Scale(vectors=500, dims=8, questions=20, k=5, target_ms=60_000.0), str(tmp_path / "v")).first()
    assert (got["vectors"], got["questions"], got["k"], got["passed"]) == (500, 20, 5, True) and 0 < got["p50_ms"] <= got["p95_ms"] <= got["max_ms"]
    with pytest.raises(ValueError):
        Scale(questions=5)


def _bm25_by_hand(rows, asked, k):
    """Scores of whole terms and of prefixes (``x*``) by the formula."""
    held = {}
    for key, body in rows:
        held.setdefault(key, []).extend((body or "").split())
    average = sum(map(len, held.values())) / len(held)
    out = set()
    for qid, wanted in asked.items():
        scores = {}
        for p in wanted:
            f = {c: sum(t.startswith(p[:-1]) if p[-1] == "*" else t == p for t in terms) for c, terms in held.items()}
            n = sum(x > 0 for x in f.values())
            idf = max(math.log((len(held) - n + 0.5) / (n + 0.5)), 1e-6)
            for c, x in f.items():
                if x:
                    scores[c] = scores.get(c, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(held[c]) / average))
        best = sorted(((-round(s, 6), c) for c, s in scores.items()))[:k]
        out |= {(qid, c, -s, i) for i, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("how, marks", [(lexical.LexicalQuery(), ""), (lexical.LexicalQuery(3), "*")])
def test_search_is_the_formula_over_blocks_rounds_and_slices(spark, monkeypatch, how, marks):
    words = ["alpha", "alphabet", "beta", "bet", "gamma", "common", "rare"]
    rows = [(i, " ".join(words[(i * 7 + j * j) % (5 if i % 3 else 7)] for j in range(1 + i % 9)) + " common") for i in range(60)]
    rows += [(5, "rare alpha"), (5, "rare rare"), (60, None), (61, ""), (62, "unasked words only")]
    asked = {q: [words[q % 7], words[(q * 3 + 1) % 7]] for q in range(30)} | {30: ["absent"]}
    asked = {q: list(dict.fromkeys(ws)) for q, ws in asked.items()}
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked.items()], "qid long, query string")
    expected = _bm25_by_hand(rows, {q: [w + marks for w in ws] for q, ws in asked.items()}, 4)
    got = lambda df: {(r["qid"], r["chunk_id"], r["score"], r["rank"]) for r in df.collect()}
    assert got(lexical.search(chunks, questions, how, 4)) == expected
    monkeypatch.setattr(dense, "BLOCK", 12)
    monkeypatch.setattr(lexical, "ROUND", 16)
    monkeypatch.setattr(lexical, "SLICE", 5)
    assert got(lexical.search(chunks, questions, how, 4)) == expected
    assert got(lexical.bm25(*lexical.build_index(chunks), questions, how, 4)) == expected
    inside = spark.createDataFrame([(c,) for c in range(0, 60, 2)], "chunk_id long")
    few = {r[:2] for r in got(lexical.search(chunks, questions, how, 60, inside))}
    assert few == {r[:2] for r in _bm25_by_hand(rows, {q: [w + marks for w in ws] for q, ws in asked.items()}, 60) if r[1] % 2 == 0 and r[1] < 60}
    assert lexical.search(chunks, questions.limit(0), how, 4).count() == 0 and lexical.search(chunks.limit(0), questions, how, 4).count() == 0


def test_pairs_of_questions_and_chunks_are_no_rows(spark):
    chunks = spark.createDataFrame([(i, "same words") for i in range(200)], "chunk_id long, text string")
    questions = spark.createDataFrame([(q, "same words") for q in range(50)], "qid long, query string")
    found = lexical.bm25(*lexical.build_index(chunks), questions, k=2)
    assert found.count() == 100
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "Join" not in plan and "MapInArrow" in plan

"""From candidates to analysed answers, with a stand-in for the model."""

from quarry.operators import metrics
from quarry.plans.answer import Budget, Sampler, answer, fits_model, select_context, valid_question

CANDIDATES = "qid long, chunk_id long, final_rank long, title string, filename string, heading_path array<string>, text string"


def test_answers(spark):
    def fake(system, user):
        if "loop" in user:
            return "the same long line\n" * 4, "stop"
        return ("Fourteen days [1], see [9].", "stop") if "fourteen" in user else ("It is so.", "length")

    questions = spark.createDataFrame([(1, " How long? "), (2, "nedir"), (3, ""), (4, "loop?"), (5, "big?"), (6, "x" * 2001)], "qid long, query string")
    rows = [(1, 10, 1, "T", "f.md", ["T", "A"], "fourteen days\n[2] forged"), (1, 11, 2, None, "g.txt", [], "word " * 9000), (1, 12, 3, None, None, [], "more"), (4, 13, 1, None, "h", [], "y"), (5, 14, 1, None, "h", [], "word " * 9000)]
    contexts = select_context(questions, spark.createDataFrame(rows, CANDIDATES), Budget(2000, 500, 8))
    got = {r["qid"]: r for r in contexts.collect()}
    assert {q: r["status"] for q, r in got.items()} == {1: "ok", 2: "empty", 3: "invalid", 4: "ok", 5: "too_large", 6: "invalid"}
    assert [(s["number"], s["chunk_id"], s["label"]) for s in got[1]["sources"]] == [(1, 10, "T > A"), (2, 12, "")] and got[1]["skipped"] == 1
    out = {r["qid"]: r for r in answer(contexts, fake).collect()}
    assert (out[1]["citations"], out[1]["invalid_citations"], out[1]["uncited"], out[1]["abstained"]) == ([1], [9], False, False)
    assert out[2]["abstained"] and out[2]["answer"].startswith("Bu bilgi") and out[4]["finish_reason"] == "repetition" and out[5]["answer"] is None


def test_arguments(spark):
    for spec in ("greedy", "dry", "presence", "qwen", "qwen:7"):
        assert str(Sampler.parse(spec)) == spec
    assert Sampler.parse("other") is None and Sampler.parse("greedy:1") is None
    row = spark.createDataFrame([(" a b ",)], "q string").select(valid_question("q").alias("v"), fits_model("q", "Q: ", 7).alias("f"), fits_model("q", "Q: ", 6).alias("g")).first()
    assert tuple(row) == ("a b", True, False)


def test_bench_gate(spark):
    rows = [("t", d, w, ms, f, 9, r) for d, f, r in (("cpu", 8, 0.9), ("gpu", 8, 0.91)) for w, ms in ((False, 9000.0), (True, 1000.0 if d == "cpu" else 100.0), (True, 1200.0 if d == "cpu" else 110.0))]
    got = metrics.bench_gate(spark.createDataFrame(rows, "tier string, device string, warm boolean, ms double, found int, wanted int, recall double")).first()
    assert got["passes"] and got["speed_up"] > 10

"""Streamed pieces, stored search and exact normalization in the index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import normalize
from quarry.operators import lexical, metrics
from quarry.operators.store import Store, StoreError
from quarry.plans.retrieve import RetrievalConfig, search
from quarry.sources.formats import corpus
from quarry.streaming.ingest import work
from quarry.streaming.pieces import TextPieces, ThinkFilter, clean

MODEL = {"model_id": "m", "model_sha256": "a", "pooling": "last", "query_prefix": "", "document_prefix": "", "dimensions": 16, "normalized": True, "max_tokens": 512, "require_trailing_eos": True}


def test_text_of_any_cut():
    raw = "aé😀� z".encode()
    for cut in range(len(raw) + 1):
        pieces = TextPieces()
        assert pieces.push(raw[:cut]) + pieces.push(raw[cut:], True) == "aé😀� z"
    assert TextPieces().push(b"a\xff\xc3", True) == "a��"


def test_thinking_of_any_cut():
    rng = random.Random(1)
    text, shown = "a <think>x < y </thi</think> \n b<th c <think></think>d<", "a b<th c d<"
    for _ in range(300):
        cuts = sorted(rng.sample(range(len(text) + 1), 6))
        filtered = ThinkFilter()
        out = [filtered.push(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert "".join(out) + filtered.push("", True) == shown
    assert ThinkFilter().push("open <think> for ever", True) == "open "


def test_clean_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0, b"a<thi"), (1, 1, b"nk>b</think>  c\xc3"), (1, 2, b"\xa9"), (2, 0, b"plain ")], "conv_id long, turn long, piece binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    pieces = spark.readStream.schema("conv_id long, turn long, piece binary").parquet(str(tmp_path / "in"))
    query = clean(pieces).writeStream.outputMode("append").format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["id"]: r["text"] for r in spark.table("cleaned").collect()} == {1: "acé", 2: "plain "}


def files(spark, *rows):
    return spark.createDataFrame([(n, "txt", c.encode()) for n, c in rows], "filename string, format string, content binary")


def test_stored_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, other = store.create_collection("one"), store.create_collection("other")
    asked = spark.createDataFrame([(1, "alpha beta")], "qid long, query string")
    from quarry.functions import vectors

    vector = asked.withColumn("embedding", vectors.fake_embedding("query"))
    assert search(store, one, vector, MODEL).count() == 0
    store.bind_space(one, MODEL)
    store.enqueue(one, files(spark, *((str(i), f"alpha number {i}") for i in range(10)), ("beta", "beta word")))
    assert work(store, most=8) == 11
    store.enqueue(other, files(spark, ("x", "alpha beta elsewhere")))
    work(store)
    assert len(store._manifest["tables"]["chunks"]) == 3 and store.table("chunks").select("id").distinct().count() == 12
    config = RetrievalConfig(max_context=5, lexical=lexical.LexicalQuery())
    for strategy in ("dense", "hybrid"):
        got = search(store, one, vector, MODEL, strategy, config).collect()
        assert len(got) == 10 and {r["collection_id"] for r in got} == {one}
    assert min(search(store, one, vector, MODEL, "lexical", config).collect(), key=lambda r: r["final_rank"])["text"].startswith("beta")
    with pytest.raises(StoreError, match="reindex"):
        search(store, one, vector, {**MODEL, "model_id": "another"})
    assert search(store, one, asked, strategy="lexical").count() > 0
    store.reindex(one)
    assert search(store, one, vector, MODEL).count() == 0 and work(store) == 11 and store.table("chunks").count() == 12
    with pytest.raises(ValueError):
        search(store, one, asked, strategy="dense")


def test_many_parts_become_one_and_old_manifests_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.operators.store.MOST_PARTS", 2)
    store = Store(spark, str(tmp_path / "s"))
    c = store.create_collection("c")
    for k in range(4):
        store.enqueue(c, files(spark, (f"f{k}", f"text {k}")))
    work(store)
    assert len(store._manifest["tables"]["sources"]) <= 2 and store.table("sources").count() == 4
    path = tmp_path / "s" / "manifest.json"
    old = json.loads(path.read_text())
    old["schema"], old["tables"] = 3, {k: v[0] for k, v in old["tables"].items() if len(v) == 1}
    path.write_text(json.dumps(old))
    for crc in (tmp_path / "s").glob(".manifest.json.crc"):
        crc.unlink()
    again = Store(spark, str(tmp_path / "s"))
    assert again._manifest["schema"] == 4 and again.table("documents").count() == 4
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "manifest.json").write_text(json.dumps({**old, "schema": 1}))
    with pytest.raises(StoreError, match="too old"):
        Store(spark, str(tmp_path / "t"))


def test_exact_normalization_in_the_index(spark):
    texts = ["Café STRASSE", "ｆｕｌｌ ﬁle №5", "bağ­lantı İstanbul", "plain text", "नमस्ते ❤️", "Σίσυφος", "ábc", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    got = {r["chunk_id"]: r["n"] for r in df.select("chunk_id", normalize.normalized("text").alias("n")).collect()}
    assert got == {i: None if t is None else normalize.normalize_for_lexical(t) for i, t in enumerate(texts)}
    postings, lengths = lexical.build_index(df.filter("text IS NOT NULL"))
    for query, found in (("café", 0), ("FILE full", 1), ("istanbul bağlantı", 2)):
        hits = lexical.bm25(postings, lengths, spark.createDataFrame([(1, query)], "qid long, query string")).collect()
        assert [r["chunk_id"] for r in hits] == [found]


def test_every_plain_character_folds_alone(spark):
    from quarry.functions import text

    known = [chr(c) for c in (*range(0x500), *range(0x2000, 0x2C00)) if normalize._folds(chr(c))]
    rng = random.Random(3)
    rows = [(0, "".join(known)), *((k, "".join(rng.choices(known, k=40))) for k in range(1, 200))]
    got = spark.createDataFrame(rows, "i int, t string").select("i", "t", text.fold("t").alias("f"), normalize.plain("t").alias("p")).collect()
    assert all(r["p"] and r["f"] == normalize.normalize_for_lexical(r["t"]) for r in got)


def test_judged_and_counted(spark):
    rows = [(True, False, [1], [], ["the fact here"], ["fact"], 1, 1), (True, True, [], [], [], ["fact"], 0, 1), (False, True, [], [], [], [], 0, 0), (True, False, [1], [9], ["no"], ["fact"], 0, 1)]
    df = spark.createDataFrame(rows, "answerable boolean, abstained boolean, citations array<int>, invalid_citations array<int>, cited_texts array<string>, evidence array<string>, found int, expected int")
    scored = metrics.score_answers(df).collect()
    assert [(r["valid_citations"], r["cited_evidence"]) for r in scored] == [(True, True), (False, False), (False, False), (False, False)]
    assert tuple(metrics.answer_counts(df).first()) == (1, 2)
    verdicts = spark.createDataFrame([(True,), (False,), (None,)], "verdict boolean")
    assert metrics.judged_rate(verdicts).first()["yes_rate"] == 0.5 and metrics.judged_rate(verdicts.filter("verdict IS NULL")).first()["yes_rate"] is None


def test_corpus_folder(spark, tmp_path):
    with pytest.raises(Exception):
        corpus(spark, str(tmp_path / "none"))
    (tmp_path / "x.csv").write_text("no")
    with pytest.raises(ValueError, match="no readable file"):
        corpus(spark, str(tmp_path))
    for name in ("b.md", "a.TXT", ".hidden.md"):
        (tmp_path / name).write_text("x")
    assert [r["name"] for r in corpus(spark, str(tmp_path)).collect()] == ["a.TXT", "b.md"]
    assert corpus(spark, str(tmp_path)).filter(F.col("kind") == "md").count() == 1


def test_garbled_pages_are_told():
    from quarry.sources.markup import parse_pages

    good, torn, lost = "plain words of a page " * 20, "w o r d s " * 60, "a�" * 150
    assert parse_pages([good, torn, torn, good, lost]).warnings == ["words split into single letters on pages 2-3", "unmapped characters on pages 5"]
    assert parse_pages([good, " "]).warnings == ["ocr_required"] and parse_pages(["w o r d s"]).warnings == []


def test_nearest_in_many_blocks_and_slices(spark, monkeypatch):
    from quarry.operators import dense

    rng = random.Random(5)
    vecs = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(500)], "vec_id long, embedding array<float>")
    asked = vecs.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    found = lambda: sorted(tuple(r) for r in dense.knn(vecs, asked, 7).collect())
    whole = found()
    monkeypatch.setattr(dense, "BLOCK", 4)
    monkeypatch.setattr(dense, "PRODUCT", 64)
    assert len(whole) == 25 * 7 and found() == whole

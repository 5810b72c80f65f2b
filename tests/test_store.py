"""The store's life cycle and the streams that feed it."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical
from quarry.operators.store import Store, StoreError
from quarry.plans import catalogue
from quarry.sources.datasets import DatasetError, load_probes, load_questions
from quarry.streaming.guard import watch
from quarry.streaming.ingest import ingest_stream, work

DESCRIPTOR = {"model_id": "m", "model_sha256": "a", "pooling": "last", "query_prefix": "", "document_prefix": "", "dimensions": 16, "normalized": True, "max_tokens": 512, "require_trailing_eos": True}


def files(spark, *rows):
    return spark.createDataFrame([(n, k, c.encode()) for n, k, c in rows], "filename string, format string, content binary")


def test_life_cycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a = store.create_collection("Alpha")
    for bad in ("alpha", " x", ""):
        with pytest.raises(StoreError):
            store.create_collection(bad)
    b = store.create_collection("Beta", protected=True)
    store.bind_space(a, DESCRIPTOR)
    got = store.enqueue(a, files(spark, ("a.md", "md", "# T\n\nalpha beta"), ("b.txt", "txt", "gamma"), ("c.txt", "txt", "gamma"), ("bad.txt", "txt", "x\0")))
    assert got.count() == 3 and got.filter("duplicate").count() == 0
    assert work(store) == 3
    again = store.enqueue(a, files(spark, ("b.txt", "txt", "gamma"), ("bad.txt", "txt", "x\0"))).collect()
    assert sorted(r["duplicate"] for r in again) == [False, True]
    assert work(store) == 1
    assert {r["status"] for r in store.table("documents").collect()} == {"ready", "failed"}
    assert store.table("chunks").count() == 2 and store.table("postings").filter("term = 'alpha'").count() == 1
    found = lexical.bm25(store.table("postings"), store.table("lengths"), spark.createDataFrame([(1, "gamma")], "qid long, query string")).first()
    assert store.table("chunks").filter(F.col("id") == found["chunk_id"]).first()["text"] == "gamma"
    page, following = store.page(a, 0, 2)
    assert len(page) == 2 and following == page[-1]["id"] and store.page(a, following, 2)[1] is None
    with pytest.raises(StoreError):
        store.bind_space(a, {**DESCRIPTOR, "model_id": "other"})
    copy = store.backup(str(tmp_path / "copy"))
    assert copy.table("documents").count() == 3
    with pytest.raises(StoreError):
        store.backup(str(tmp_path / "copy"))
    assert store.reindex(a) == 3 and store.table("chunks").count() == 0
    with pytest.raises(StoreError, match="busy"):
        store.reindex(a)
    job, document = store.claim()
    store.requeue_running()
    assert store.claim() == (job, document)
    store.delete_document(document)
    assert not store.publish(job, store.table("chunks")) and store.table("sources").count() == 2
    with pytest.raises(StoreError):
        store.delete_collection(b)
    store.delete_collection(a)
    assert store.table("documents").count() == store.table("sources").count() == store.table("spaces").count() == 0
    assert Store(spark, str(tmp_path / "s")).collections().count() == 1


def test_ingest_stream(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), tmp_path / "in"
    folder.mkdir()
    c = store.create_collection("c")
    (folder / "a.md").write_text("# A\n\none two")
    (folder / "x.csv").write_text("no")
    for _ in range(2):
        ingest_stream(spark, str(folder), store, c, str(tmp_path / "cp")).awaitTermination(120)
        (folder / "b.txt").write_text("one two three")
    docs = store.table("documents").collect()
    assert sorted((d["filename"], d["status"], d["title"]) for d in docs) == [("a.md", "ready", "A"), ("b.txt", "ready", None)]


def test_a_stream_goes_on_with_what_a_lost_run_had_begun(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), tmp_path / "in"
    folder.mkdir()
    c = store.create_collection("c")
    (folder / "a.txt").write_text("one two")
    (folder / "no.pdf").write_text("not a PDF")
    store.enqueue(c, files(spark, ("a.txt", "txt", "one two"), ("b.txt", "txt", "three")))
    assert store.claim_batch().count() == 2  # and then the run is lost
    ingest_stream(spark, str(folder), Store(spark, str(tmp_path / "s")), c, str(tmp_path / "cp")).awaitTermination(120)
    docs = Store(spark, str(tmp_path / "s")).table("documents").collect()
    assert sorted((d["filename"], d["status"]) for d in docs) == [("a.txt", "ready"), ("b.txt", "ready")]


def test_repeat_guard_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0, "the same long line\n" * 3), (2, 0, "a line of text\nother\n")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "in"))
    pieces = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
    query = watch(pieces).writeStream.outputMode("update").format("memory").queryName("looped").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["conv_id"]: r["looped"] for r in spark.table("looped").collect()} == {1: True, 2: False}


def test_datasets(spark, tmp_path):
    good = '{"id":"a","lang":"tr","query":"q","relevant":[{"document":"d","contains":"c"}],"answerable":true}\n\n{"id":"b","lang":"tr","query":"q","relevant":[],"answerable":false}\n'
    (tmp_path / "q.jsonl").write_text(good)
    assert load_questions(spark, str(tmp_path / "q.jsonl")).count() == 2
    for bad in (good.replace('"id":"b"', '"id":"a"'), good.replace('"answerable":false', '"answerable":true'), good.replace('"lang"', '"lnag"'), good.replace('"answerable":true', '"answerable":true,"require_all":true')):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(DatasetError):
            load_questions(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "p.jsonl").write_text('{"id":"a","lang":"tr","query":"q","expect":["x|y"],"answerable":true}\n')
    assert load_probes(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "p.jsonl").write_text('{"id":"a","lang":"tr","query":"q","expect":["x|"],"answerable":true}\n')
    with pytest.raises(DatasetError):
        load_probes(spark, str(tmp_path / "p.jsonl"))


def test_changes_touch_only_ranges_of_ids(spark, tmp_path, monkeypatch):
    from quarry.operators import store as module

    monkeypatch.setattr(module, "RANGE", 4)
    store = Store(spark, str(tmp_path / "s"))
    key = store.create_collection("c")
    store.enqueue(key, files(spark, *((f"{k}.txt", "txt", f"text number {k}") for k in range(10))))
    parts = lambda name: {p.rsplit("=", 1)[1]: p for p in store._manifest["tables"][name]}
    before = {name: parts(name) for name in ("jobs", "documents")}
    assert sorted(before["jobs"]) == ["0", "1", "2"] and store.table("jobs").count() == store.table("documents").count() == 10
    taken = store.claim_batch(3)
    assert sorted(r["job"] for r in taken.collect()) == [1, 2, 3]
    for name in before:
        assert {r for r in before[name] if parts(name)[r] != before[name][r]} == {"0"}
    store.fail(1, "no")
    assert work(store) == 7
    states = {r["id"]: r["status"] for r in store.table("jobs").collect()}
    assert [states[k] for k in range(1, 11)] == ["failed", "running", "running"] + ["succeeded"] * 7
    assert store.claim() is None
    store.requeue_running()
    assert store.claim()[0] == 2 and store.claim()[0] == 3
    # what failed is queued again under a new job, later ones as more ranges
    again = store.enqueue(key, files(spark, ("0.txt", "txt", "text number 0"), *((f"{k}.txt", "txt", f"text number {k}") for k in range(1, 12))))
    assert again.filter("NOT duplicate").count() == 3
    assert work(store) == 3 and store.table("documents").filter("status = 'ready'").count() == 10
    assert store.table("documents").select("id").distinct().count() == store.table("documents").count() == 12
    opened = Store(spark, str(tmp_path / "s"))
    assert opened.table("jobs").count() == 13 and opened.table("chunks").count() == 10


def test_a_deleted_document_is_gone_without_a_rewrite(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    key, other = store.create_collection("c"), store.create_collection("d")
    store.enqueue(key, files(spark, *((f"{k}.txt", "txt", f"text number{k}") for k in range(5))))
    store.enqueue(other, files(spark, ("0.txt", "txt", "text number0")))
    assert work(store) == 6
    of = lambda name, collection=key: store.table("documents").filter((F.col("collection_id") == collection) & (F.col("filename") == name)).first()["id"]
    before = {name: list(store._manifest["tables"][name]) for name in ("chunks", "postings", "lengths", "sources")}
    store.delete_document(of("1.txt"))
    store.delete_document(of("0.txt"))
    for again in (store, Store(spark, str(tmp_path / "s"))):
        assert {name: again._manifest["tables"][name] for name in before} == before
        assert again.table("documents").count() == again.table("jobs").count() == again.table("chunks").count() == again.table("lengths").count() == 4
        # the other collection still has the content of one of them
        assert again.table("sources").count() == 4 and again.table("postings").filter("term IN ('number0', 'number1')").count() == 1
    with pytest.raises(StoreError):
        store.delete_document(999)
    # what is deleted may come back, as a document of its own
    assert store.enqueue(key, files(spark, ("1.txt", "txt", "text number1"))).filter("NOT duplicate").count() == 1
    assert work(store) == 1 and store.table("sources").count() == 5 and store.table("chunks").count() == 5
    counts = {name: store.table(name).count() for name in store._manifest["tables"] if name != "gone"}
    copy = store.backup(str(tmp_path / "copy"))
    store.compact()
    assert {name: store.table(name).count() for name in counts} == counts == {name: copy.table(name).count() for name in counts}
    assert store.table("gone").count() == 0 and all(set(store._manifest["tables"][name]).isdisjoint(before[name]) for name in before)
    store.delete_document(of("2.txt"))
    assert store.reindex(key) == 3 and work(store) == 3 and store.table("chunks").count() == 4
    store.delete_collection(key)
    assert store.table("chunks").count() == store.table("sources").count() == store.table("documents").count() == 1


def test_ranges_of_many_parts_are_joined(spark, tmp_path, monkeypatch):
    from quarry.operators import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    store = Store(spark, str(tmp_path / "s"))
    key = store.create_collection("c")
    for k in range(4):
        store.enqueue(key, files(spark, (f"{k}.txt", "txt", f"text {k}")))
    assert len(store._manifest["tables"]["jobs"]) <= 2 and store.table("jobs").count() == 4
    assert work(store) == 4 and len(store._manifest["tables"]["documents"]) == 1


def test_a_stored_batch_is_broadcast_to_the_documents(spark, monkeypatch):
    seen, publish = [], Store.publish_batch
    monkeypatch.setattr(Store, "publish_batch", lambda self, outcomes, chunks: seen.append(chunks._jdf.queryExecution().withCachedData().toString()) or publish(self, outcomes, chunks))
    catalogue.QUERIES["stored_hybrid_search"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "strategy=broadcast" in seen[0] and "InMemoryRelation" in seen[0]
    spark.catalog.clearCache()

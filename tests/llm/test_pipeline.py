"""The pipeline's stages on a small table, against brute force where there is one."""

from collections import Counter

import corpus_pipeline
from test_operators import SF, brute_components, brute_lines, check_packed


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, good, lined, single, mixed, packed = kept
    assert all(d.columns == columns for d in kept[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r["doc_id"] for r in good.collect()}
    clean = [k for k, y in labels.items() if y == 1]
    assert sum(k in stays for k in clean) / len(clean) > 0.97
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == sorted((k, t) for k, t, *_ in brute_lines([(r["doc_id"], r["text"]) for r in good.collect()]))
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    parts = brute_components([(r["doc_id"], r["text"]) for r in lined.collect()])
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in parts}
    assert 0.75 * single.count() < mixed.count() <= single.count()
    rows = packed.collect()
    check_packed(rows, 2048)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_copies_under_repeated_and_missing_ids(spark):
    base = [f"w{i}" for i in range(80)]
    near, other, third = " ".join(base), " ".join(f"o{i}" for i in range(40)), " ".join(f"t{i}" for i in range(40))
    rows = [(1, near), (1, near), (2, near + " tail"), (2, other), (None, near), (None, third), (None, third), (4, ""), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, near), (2, other), (None, third), (4, ""), (4, None)])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark, make, odd_rows):
    """Null ids and texts, repeated rows, very long texts, other columns of clashing names."""
    docs = make(*odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        if name == "best-fit packing":
            check_packed(got, 2048)
            assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(k for k, *_ in odd_rows)
        else:
            assert all(tuple(r.asDict()) == tuple(corpus_pipeline.COLUMNS) for r in got) and len(got) <= len(odd_rows)
        if name == "line dedup":
            assert Counter(r["doc_id"] for r in got) == Counter(k for k, *_ in odd_rows) and sum(r["text"] is None for r in got) == 2

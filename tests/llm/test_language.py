"""Language identification: held-out accuracy, rejection, exact sums in blocks, odd rows."""

import zlib

import numpy as np
import pytest

from quarry.llm import language
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_query_predicts_held_out_documents(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = QUERIES["op11_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "fr", "de", "es", "und"}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) >= 0.99
    kept = [r for r in held if r["accepted"]]
    assert len(kept) > 0.95 * len(held) and np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in kept]) >= 0.995


def test_held_out_rows_and_other_columns_teach_nothing(spark, model):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    again = language.train(spoilt)
    assert again.langs == model.langs and np.array_equal(again.embedding, model.embedding) and again.temperature == model.temperature


def test_training_does_not_depend_on_the_order_of_rows(spark, model):
    again = language.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    assert np.array_equal(again.embedding, model.embedding) and np.array_equal(again.weight, model.weight)


def test_rejection(model):
    lang, score, accepted = model.predict(["Привет мир, это русский текст о погоде", "漢字かな交じり文", "The of and that.", "", None, "12 !?"])
    assert not accepted[[0, 1, 3, 4, 5]].any() and accepted[2] and lang[2] == "en"
    assert lang[3:] == ["und"] * 3 and (score[3:] == 0).all()


def test_blocks_change_no_sum(model, monkeypatch):
    texts = ["", "a", "der und " * 3000, None, "the quick brown", "x" * 9000, "ça va, été"]
    whole = model.logits(texts)
    monkeypatch.setattr(language, "_BLOCK", 1 << 12)
    parts = model.logits(texts)
    one = [model.logits([t]) for t in texts]
    for k in range(3):
        assert np.allclose(whole[k], parts[k]) and np.allclose(whole[k], np.concatenate([o[k] for o in one]))


def test_subwords_are_runs_inside_one_word():
    text = "Été 9x"
    rows, counts = language.subword_counts(text, 16)
    # of " été x ": runs of one to five code points whose inside is letters and that hold one
    padded = " été  x "
    want = sum(1 for n in range(1, 6) for i in range(len(padded) - n + 1) if _is_subword(padded[i : i + n]))
    assert counts.sum() == want and len(rows) <= want


def _is_subword(s):
    return s.isalpha() if len(s) == 1 else any(c.isalpha() for c in s) if len(s) == 2 else s[1:-1].isalpha()


def test_factors_multiplied_out_or_not(model):
    rng = np.random.default_rng(0)
    many = language.LanguageModel(model.bits, [f"l{k}" for k in range(40)], model.embedding, model.met, rng.normal(size=(40, model.embedding.shape[1])), np.zeros(40))
    few = language.LanguageModel(model.bits, many.langs[:5], model.embedding, model.met, many.weight[:5], np.zeros(5))
    texts = ["the of and", "été à la", "x"]
    assert np.allclose(many.logits(texts)[0][:, :5], few.logits(texts)[0], atol=1e-5)


def test_odd_rows(spark, make, odd_rows, model):
    got = language.identify(make(*odd_rows), model).collect()
    assert len(got) == len(odd_rows)
    of = {r["doc_id"]: r for r in got}
    assert of[1]["lang_pred"] == of[2]["lang_pred"] == of[3]["lang_pred"] == of[14]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    trained = language.train(make(*odd_rows))
    assert {r["lang_pred"] for r in language.identify(make(*odd_rows), trained).collect()} == {"en", "und"}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "words", None)], [(1, "12 34", "en")]])
def test_nothing_to_learn(spark, make, rows):
    docs = make(*rows) if rows else make().limit(0)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in got)


def test_a_hot_group_of_copies_counts_once(spark, make):
    ids = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, "the same words over and over", "en") for k in ids[:1500]] + [(ids[1500 + k], f"le mot numéro {k} était là", "fr") for k in range(200)]
    model = language.train(make(*rows), max_rows=100)
    assert model.langs == ["en", "fr"]
    assert model.predict(["le mot était", "the words over"])[0] == ["fr", "en"]

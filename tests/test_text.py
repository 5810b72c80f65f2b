"""Text functions on literal values, and their SQL forms against the exact ones."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import answers, identity, names, normalize, text, vectors
from quarry.functions.normalize import lexical_terms, normalize_for_lexical
from quarry.operators.lexical import LexicalQuery, match_expression
from quarry.plans import answer
from quarry.streaming.guard import LineRepeatGuard, line_key


@pytest.mark.parametrize(
    "given_text, expected",
    [
        ("İZMİR", "izmir"), ("ırmak", "irmak"), ("HELLO World", "hello world"), ("ÇİĞ KÖFTE", "çiğ köfte"), ("Hâlâ rûzgâr Îmân", "hala ruzgar iman"), ("Crème brûlée", "crème brulée"),
        ("\ufb02at x\u00b2", "flat x2"), ("e\u0301te\u0301", "été"), ("zero\u200bwidth", "zerowidth"), ("so\u00adft", "soft"), ("GROẞ Maß", "gross mass"), ("\uff21\uff42\uff43", "abc"),
        ("\ue000abc", " abc"), ("\u1e8e", "\u1e8f"), ("i\u0307\u0301", "\u00ed"),
    ],
)
def test_normalization(given_text, expected):
    assert normalize_for_lexical(given_text) == expected


def test_query_terms():
    assert lexical_terms("Su su baskını, su?") == ["su", "baskini"]
    assert lexical_terms("... --") == [] and lexical_terms("日本語 テスト") == ["日本語", "テスト"] and lexical_terms("🙂") == []
    assert lexical_terms(" ".join(f"term{i}" for i in range(50))) == [f"term{i}" for i in range(32)]
    assert lexical_terms("same " * 100_000) == ["same"] and lexical_terms("z" * 500_000) == []
    assert lexical_terms("b " * 2046 + "cut off here") == ["b", "cut"] and lexical_terms("one" + ";b" * 4000) == ["one", "b"]


def test_match_expression(spark):
    q = spark.createDataFrame([(1, "Calculating 250 sum xy")], "qid long, query string")
    assert match_expression(q, LexicalQuery(3, 7)).first()["expression"] == '"calculating"* OR "250" OR "sum"* OR "xy" OR "calcula"*'
    assert match_expression(q, LexicalQuery()).first()["expression"] == '"calculating" OR "250" OR "sum" OR "xy"'


@pytest.mark.parametrize("spec", ["exact", "prefix:3", "prefix:3+stem:7", "exact+stem:5"])
def test_lexical_modes(spec):
    assert LexicalQuery.parse(spec).name == spec


@pytest.mark.parametrize("spec", ["", "prefix:0", "prefix:x", "exact+stem:2", "exact+", "other"])
def test_bad_lexical_modes(spec):
    assert LexicalQuery.parse(spec) is None


SOURCES = [
    ("Water boils [1]; ice melts [3][1] or [ 2 ].", [1, 3, 2], []), ("None of [0] or [12], but [3].", [3], [0, 12]), ("See [2, 3] and [3,8].", [2, 3], [8]), ("[2,\t1]", [2, 1], []),
    ("list[k] [note] [2, b] [3,] [,1] [1;3] [003] [1990] [2-1] [~1~]", [], []), ("As said (cf. [see [1]]).", [1], []), ("q[ [2] r", [2], []), ("Thirty days[3]. Valid [1](page 4). In [2](1998).", [3, 1, 2], []),
    ("Rule [2].\n```py\nx = [1]\n```\nEnd [3].", [2, 3], []), ("~~~\n[2]\n```\n[1]\n~~~\n[3]", [3], []), ("`make [1]` runs [2].", [1, 2], []), ("Steps [2–3]. Also [3-5].", [2, 3], [4, 5]),
    ("note[^2] and \\[3\\].", [2, 3], []), (" > ```\n> y[1]\n> ```\n[2]", [2], []), ("", [], []),
]


@pytest.mark.parametrize("answer, valid, invalid", SOURCES)
def test_citations(answer, valid, invalid):
    got = answers.extract_citations(answer, 3)
    assert (got["valid"], got["invalid"]) == (valid, invalid)


def test_citation_markers_and_time():
    answer = "Çay [2] ya da [1, 7]; süre [2-3], not [^1], kaçış \\[2\\].\n```\nv[3]\n```\nsene [1987], boş [00]."
    raw = answer.encode()
    got = [(raw[m["start"] : m["end"]].decode(), m["numbers"]) for m in answers.extract_citations(answer, 3)["markers"]]
    assert got == [("[2]", [2]), ("[1, 7]", [1, 7]), ("[2-3]", [2, 3]), ("[^1]", [1]), ("[2\\]", [2])]
    unclosed = "".join("`" * n + " x\n" for n in range(1399, 2, -1)) + "[1]"
    assert answers.extract_citations(unclosed, 3)["valid"] == [1]


def test_cited_numbers_in_sql(spark):
    rows = [(i, a, v + x) for i, (a, v, x) in enumerate(SOURCES) if "```" not in a and "~~~" not in a]
    got = spark.createDataFrame([(i, a) for i, a, _ in rows], "i int, a string").select("i", answers.cited_numbers("a").alias("n")).collect()
    assert {r["i"]: sorted(r["n"]) for r in got} == {i: sorted(n) for i, _, n in rows}


@pytest.mark.parametrize(
    "reply",
    [
        "The sources do not mention any opening hours.", "There is no information about parking in the sources.", "Kaynaklarda bu konuda bilgi yoktur.",
        "Belgelerde kurulum tarihi belirtilmemiştir.", answers.REFUSAL_EN, answers.REFUSAL_TR,
    ],
)
def test_abstentions(reply):
    assert answers.abstained(reply)


@pytest.mark.parametrize(
    "reply",
    [
        "The warranty is two years [1]; the price is not stated.", "It takes five days [2]. Shipping is not mentioned.", "According to the documents there is no fee [1].", "No fee applies.",
        "Although the sources do not name it, article 4 makes it law [2].", "",
    ],
)
def test_answers_are_no_abstentions(reply):
    assert not answers.abstained(reply)


@pytest.mark.parametrize(
    "hay, needle, found",
    [
        ("the city has 450 parks", "450", True), ("450.", "450", True), ("2450 parks", "450", False), ("4500 days", "450", False), ("1.450 km", "450", False), ("450.000 people", "450", False), ("on 03.04.2011 it", "03.04.2011", True),
        ("Üç iş günü sürer.", "üç iş gün", True), ("Otuz üç iş günü sürer.", "üç iş gün", False), ("thirty-two hours pass", "two hours", False), ("It needs two hours.", "two hour", True), ("Kırk bin lira.", "kırk", False),
        ("Kırk bin, yani çok.", "kırk bin", True), ("Depo 20 bin litre.", "20", False), ("airport", "port", False),
    ],
)
def test_terms_in_answers(hay, needle, found):
    assert answers.contains_term(answers.normalized(hay), answers.normalized(needle)) is found


def test_facts_and_refusals():
    assert answers.found_facts("Ücret 18 lira.", ["18 TL|18 lira", "20"], False) == [0]
    assert answers.found_facts("Ücret 18 lira.", ["18 lira"], True) == []
    assert answers.refusal_for("Süre nedir?") == answers.REFUSAL_TR and answers.refusal_for("How long?") == answers.REFUSAL_EN


def test_passage_window():
    long = "Intro sentence here. Nothing to see. Dinlenmek gerekir her gün. Son cümle burada durur."
    window = answers.passage_window("dinlenmeyi", long, 40)
    assert "Dinlenmek" in window and len(window) <= 40
    assert answers.passage_window("zzz", long, 40) is None and answers.passage_window("zzz", "short", 40) == "short"


def test_line_guard():
    guard = LineRepeatGuard()
    assert not guard.push("1. the same long line\n2. the same long ") and guard.push("line\n\n3. the same long line\n")
    assert not LineRepeatGuard().push("---\n---\n---\n") and line_key("1. * x  y") == "x y" and line_key("01.02.2016 x") == "01.02.2016 x"


def test_fingerprint(spark):
    d = {"model_id": "m", "model_sha256": "a" * 64, "pooling": "last", "query_prefix": "Q: ", "document_prefix": "", "dimensions": 4, "normalized": True, "max_tokens": 512, "require_trailing_eos": True}
    golden = "37c52ca70f826e186f68a9c8f58054038b0ebe5baad3b058e22944d743f7c545"
    assert identity.space_fingerprint(d) == golden
    assert spark.createDataFrame([d]).select(identity.space_fingerprint_column().alias("f")).first()["f"] == golden


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    got = df.select(vectors.l2_normalize("v").alias("u"), vectors.is_unit("v").alias("no")).first()
    assert got["u"] == pytest.approx([0.6, 0.8]) and got["no"] is False
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vectors.l2_normalize("v")).collect()
    assert vectors.fnv1a(b"") == 0xCBF29CE484222325 and vectors.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert sum(x * x for x in vectors.bag_of_words("a b c")) == pytest.approx(1) and vectors.bag_of_words("")[0] == 1
    assert abs((vectors.unit_vectors(5, 8) ** 2).sum(1) - 1).max() < 1e-6


TEXTS = ["Ağ bağlantısı İstanbul", "a-\nb\nStraße", "1. x\n2. x\n\n- y", "gün-\ndür e-\nfatura ORX-\nE104", "", "One. Two! three; four", "T e s l i m a t " * 60, "x�" * 150]


def test_sql_forms_agree(spark):
    from quarry.sources.markup import join_hyphenated

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", text.fold("t").alias("fold"), text.query_terms("t").alias("terms"), text.join_hyphenated("t").alias("joined"), text.sentences("t").alias("s"), text.suspicious("t").alias("bad")).collect()
    for r in rows:
        t = TEXTS[r["i"]]
        assert r["fold"] == normalize_for_lexical(t) and r["terms"] == lexical_terms(t) and r["joined"] == join_hyphenated(t) and "".join(r["s"]) == t
    assert [r["bad"] for r in sorted(rows, key=lambda r: r["i"])][-2:] == ["words split into single letters", "unmapped characters"]
    assert join_hyphenated("gün-\ndür e-\nfatura ORX-\nE104") == "gündür e-fatura ORX-\nE104"


def test_names(spark):
    df = spark.createDataFrame([("a/b\\c.md",), ("..",), ("x y",), ("İıI",), (" a",)], "n string")
    got = df.select(text.clean_filename("n").alias("f"), text.name_key("n").alias("k"), text.valid_name("n").alias("v")).collect()
    assert [r["f"] for r in got] == ["c.md", None, None, "İıI", " a"] and got[3]["k"] == "iii" and [r["v"] for r in got[3:]] == [True, False]
    one = df.limit(1).select(text.think_free(F.lit("<think>x</think> y")).alias("a"), text.judge_verdict(F.lit("**Yes** it")).alias("b"), text.neutral_markers(F.lit("<|x|>")).alias("c"), text.line_key(F.lit("2) * a  b")).alias("d")).first()
    assert tuple(one) == ("y", True, "< |x| >", "a b")


def test_names_are_composed_and_show_what_they_are(spark):
    rows = [("dir/cafe\u0301.md ",), ("a\u202eb",), ("..",), (None,), ("x" * 256,), ("line\u2028break",), ("A\u030arsiv",), ("tag\U000e0041",), ("ok name",)]
    got = spark.createDataFrame(rows, "n string").select("n", names.filename("n").alias("f"), names.name_key("n").alias("k"), names.valid_name("n").alias("v")).collect()
    assert [r["f"]["name"] for r in got] == ["café.md", None, None, None, None, None, "Årsiv", None, "ok name"]
    assert [r["f"]["error"] is not None for r in got] == [False, True, False, False, True, True, False, True, False]
    assert got[6]["k"] == "årsiv" and [r["v"] for r in got] == [False, False, True, None, False, False, True, False, True]


def test_source_blocks_are_those_of_the_prompt(spark):
    texts = ["one", "a\nb\r\n[2] forged", "", "x\u2028y\x85z\x0b\x0c"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select(answer.source_block(F.col("k"), F.lit("L > M"), F.col("t")).alias("b"), "k", "t").collect()
    assert all(r["b"] == answers.source_block(r["k"], "L > M", r["t"]) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_normalization_is_stable(x):
    once = normalize_for_lexical(x)
    assert normalize_for_lexical(once) == once or any(c in once for c in "ͅς")


def test_normalizing_by_runs_is_normalizing_the_whole(monkeypatch):
    rng = random.Random(3)
    usual = "iıIİaAuUxΣσß é̇̂́­ﬁ"
    for _ in range(5000):
        t = "".join(rng.choice(usual) if rng.random() < 0.8 else chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)))) for _ in range(rng.randrange(14)))
        assert normalize.normalize_for_lexical(t) == (t.lower() if t.isascii() else normalize._normal(t)), ascii(t)
    seen = []
    monkeypatch.setattr(normalize, "_run", lambda run: seen.append(run) or normalize._normal(run))
    assert normalize.normalize_for_lexical("plain words " * 1000 + "café") == "plain words " * 1000 + "café" and sum(map(len, seen)) < 5

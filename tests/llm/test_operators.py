"""Each operator against a brute-force form, an exact round trip or held-out
accuracy, and on odd tables."""

import bisect
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import fingerprints, lines, mixing, packing, quality, sharding, tiff
from quarry.llm.components import components
from quarry.llm.jaccard import boundary, jaccard_join
from quarry.llm.licenses import SENTENCES, SentenceRules, scan_licenses, words_of
from quarry.llm.queries import QUERIES, SHARDS, tokenizer_path
from quarry.llm.substring import substring_dedup

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def texts_of(spark, sf=SF):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def near_copies(seed=3, groups=12, size=9):
    """Documents with exact and near copies, shared passages and small sets."""
    rng = random.Random(seed)
    rows, key = [], 0
    passage = [f"shared{i}" for i in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 140]))]
        if g % 3 == 0:
            base += passage
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(1000)}"
            rows.append((key, " ".join(own).upper() if rng.random() < 0.2 else "  ".join(own)))
            key += 1
    rng.shuffle(rows)
    return rows


# --- 1 n-gram Jaccard join --------------------------------------------------------


def brute_components(rows, width=5):
    """n_shingles and component of each row, where every pair of rows is compared."""
    sets = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids = [LAST if k is None else k for k, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both and 100 * both >= 75 * len(sets[i] | sets[j])) or (ids[i] == ids[j] and sets[i] == sets[j] and sets[i]):
                parent[find(i)] = find(j)
    low = defaultdict(lambda: LAST)
    for i in range(len(rows)):
        low[find(i)] = min(low[find(i)], ids[i])
    none = lambda k: None if k == LAST else k
    return sorted(((none(ids[i]), len(sets[i]), none(low[find(i)])) for i in range(len(rows))), key=repr)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join(make, seed):
    rows = near_copies(seed)
    assert joined(jaccard_join(make(*rows), group_bytes=2000, bucket_hashes=300)) == brute_components(rows)


def test_jaccard_join_of_a_large_group(make):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"n{k}_{rng.randrange(9)}"
        rows.append((k, " ".join(own)))
    assert joined(jaccard_join(make(*rows))) == brute_components(rows)


def test_jaccard_join_of_odd_rows(make, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert joined(jaccard_join(make(*odd_rows))) == brute_components(rows)
    assert jaccard_join(make()).count() == 0


def test_jaccard_query(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op1_jaccard_join"](spark, SF).collect()}
    assert got == {k: (n, c) for k, n, c in brute_components(texts_of(spark))}


def brute_links(rows, width=5):
    """For each row how many others it is linked with, where every pair of rows is compared."""
    sets = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    linked = lambda a, b: bool(a & b) and 4 * len(a & b) >= 3 * len(a | b)
    return sorted(((k, len(s), sum(linked(s, o) for j, o in enumerate(sets) if j != i)) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def links_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"block_sets": 7}, {"block_sets": 5, "block_shingles": 300}])
def test_jaccard_links(make, odd_rows, how):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = near_copies(4, groups=6)
    for k in range(1000, 1060):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"n{rng.randrange(99)}"
        rows.append((k, " ".join(own)))
    # one id with two near copies that have no other partner
    rows += [(2000, " ".join(f"t{i}" for i in range(50))), (2000, " ".join(f"t{i}" for i in range(51)))]
    for given_rows in (rows, [r[:2] for r in odd_rows]):
        found = brute_links(given_rows)
        assert links_of(jaccard_join(make(*given_rows), group_bytes=2000, bucket_hashes=300, **how)) == found and any(r[2] > 1 for r in found)
    assert "n_links" not in jaccard_join(make(*rows[:9]), count_links=False).columns


def test_jaccard_links_of_the_query(spark):
    assert links_of(QUERIES["op1_jaccard_join"](spark, SF)) == brute_links(texts_of(spark))


def test_boundary_and_components(spark):
    assert boundary([(2, 1, 5), (4, 2, 5), (8, 50, 6)]) == 4 and boundary([(2, 9, 1)]) == 0 and boundary([]) == 0
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 90)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 60 for i in range(60, 90)}, 100: 60}


# --- 2 substring dedup --------------------------------------------------------------


def brute_substring(rows, width=20):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (LAST if rows[i][0] is None else rows[i][0], rows[i][1] or ""))
    for i in order:
        w = words(rows[i][1])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((rows[i][0], len(w), sum(gone), kept))
    return sorted(out, key=repr)


def cut(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=repr)


def test_substring_dedup(make, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert cut(substring_dedup(make(*odd_rows))) == brute_substring(rows)
    assert cut(substring_dedup(make(*odd_rows), group_bytes=3000, bucket_windows=500)) == brute_substring(rows)
    rows = near_copies(9)
    assert cut(substring_dedup(make(*rows), width=6, group_bytes=1000, bucket_windows=100)) == brute_substring(rows, 6)
    assert substring_dedup(make()).count() == 0


def test_substring_intervals(make):
    a = [f"a{i}" for i in range(30)]
    got = substring_dedup(make((1, " ".join(a)), (2, "x " + " ".join(a[:25]) + " y " + " ".join(a[5:])))).filter("doc_id = 2").first()
    assert [tuple(r) for r in got["removed"]] == [(1, 26), (27, 52)] and got["kept_text"] == "x y"


def test_substring_query(spark):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op2_substring_dedup"](spark, SF).collect())
    assert got == [(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in sorted(brute_substring(texts_of(spark)))]


# --- 3 line dedup ----------------------------------------------------------------------


def brute_lines(rows, window=2, divisor=2, least=2):
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    seen, out = {}, []
    chunked = []
    for k, text in rows:
        ls = [] if text is None else text.split("\n")
        chunks, own = [], []
        for i, line in enumerate(ls):
            own.append(line)
            value = 0
            for b in range(window - 1, -1, -1):
                value = (value * 1_000_003 + (h(ls[i - b]) if i >= b else 0)) % (2**31 - 1)
            if i == len(ls) - 1 or value % divisor == 0:
                chunks.append(own)
                own = []
        chunked.append(chunks)
        for c in chunks:
            seen[tuple(c)] = min(seen.get(tuple(c), LAST), LAST if k is None else k)
    for (k, text), chunks in zip(rows, chunked):
        kept, here = [], set()
        for c in chunks:
            earlier = seen[tuple(c)] < (LAST if k is None else k) or tuple(c) in here
            here.add(tuple(c))
            if len(c) < least or not earlier:
                kept += c
        n = sum(map(len, chunks))
        out.append((k, None if text is None else "\n".join(kept), n, n - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(make, odd_rows):
    rng = random.Random(4)
    shared = [f"shared line {i}" for i in range(12)]
    rows = [(k, "\n".join([f"own {k} {i}" for i in range(rng.randrange(4))] + shared[rng.randrange(6) :] + [f"end {k}"])) for k in range(40)]
    for given_rows in (rows, odd_rows):
        df = make(*given_rows)
        got = lines.line_dedup(df)
        assert got.columns == df.columns + ["n_lines", "_n_removed_lines"]
        found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["_n_removed_lines"]) for r in got.collect()), key=repr)
        assert found == brute_lines([r[:2] for r in given_rows])
    assert lines.line_dedup(make()).count() == 0


def test_line_dedup_realigns(make):
    shared = [f"shared line {i}" for i in range(40)]
    got = lines.line_dedup(make((1, "\n".join(shared)), (2, "\n".join(["inserted", *shared])))).filter("doc_id = 2").first()
    assert got["_n_removed_lines"] > 20


# --- 4 media ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text(alphabet="ab", max_size=6000).map(str.encode)))
def test_codecs(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(how, predictor, tiled):
    samples = np.random.default_rng(1).integers(0, 256, (150, 576), dtype=np.uint8)
    pages = list(tiff.decode_tiff(tiff.encode_tiff(samples, how, predictor, tiled, page_rows=70)))
    assert [len(p) for _, _, p in pages] == [70, 70, 10] and (np.vstack([p for _, _, p in pages]) == samples).all()
    assert {(c, p) for c, p, _ in pages} == {(how, 2 if predictor else 1)}


def test_tiff_of_another_writer():
    """A big-endian file with colour samples, one strip, no compression tag."""
    import struct

    pixels = bytes(range(12))
    tags = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (273, 4, 8), (277, 3, 3), (279, 4, 12)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">H", v) + b"\0\0" if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    data = b"MM\0*" + struct.pack(">I", 20) + pixels + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"
    ((how, predictor, page),) = tiff.decode_tiff(data)
    assert (how, predictor) == (1, 1) and page.tobytes() == pixels and page.shape == (2, 6)


def test_broken_tiff(spark):
    good = tiff.store(tiff.payload_of(b"x" * 5000))
    for bad in (b"", b"II", good[:30], good[: len(good) // 2], b"II*\0" + b"\xff" * 40):
        with pytest.raises(tiff.TiffError):
            list(tiff.decode_tiff(bad))
    rows = spark.createDataFrame([(1, good), (2, b"no"), (3, None)], "doc_id long, media binary")
    assert [r["doc_id"] for r in tiff.tiff_pages(rows).collect()] == [1]


def test_tiff_media(make, odd_rows):
    media = tiff.text_media(make(*odd_rows))
    got = sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in tiff.media_features(media).collect()), key=repr)
    expected = []
    for k, text, *_ in odd_rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        expected.append((k, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == sorted(expected, key=repr)
    pages = tiff.tiff_pages(media)
    assert pages.count() == tiff.media_features(media).agg(F.sum("pages")).first()[0] and pages.filter("page = 1").count() == 1
    assert tiff.media_features(tiff.text_media(make())).count() == 0


# --- 5 sharding -----------------------------------------------------------------------------


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1 and table == sharding.lookup_table(names, 1009)
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.25 * 1009
    heavy = Counter(sharding.lookup_table(names, 1009, [3] + [1] * 9))
    assert heavy[0] > 2.5 * heavy[1]
    for bad in ((names, 1000, None), ([], 7, None), (["a", "a"], 7, None), (names, 1009, [0] * 10)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(spark, make, odd_rows):
    got = sharding.assign_shards(make(*odd_rows), "doc_id", SHARDS).collect()
    assert len(got) == len(odd_rows) and len({r["shard"] for r in got if r["doc_id"] == 6}) == 1
    table = sharding.lookup_table(SHARDS)
    assert all(table[r["slot"]] == r["shard"] for r in got) and sharding.assign_shards(make(), "doc_id", SHARDS).count() == 0
    assert QUERIES["op5_table_sharding"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# --- 6 license scans ------------------------------------------------------------------------


def test_license_sentences():
    scan = SentenceRules()
    for name, sentence in SENTENCES:
        assert scan.sentence_ids(f"before.\n{sentence}.\nafter.") == [None, name]
        wrapped = re.sub(r"(\S+ \S+ \S+) ", r"\1\n# ", sentence)
        assert scan.sentence_ids(f"# {wrapped}.") == [name]
    assert all(scan.begins.search(s.lower().replace("licence", "license")) for _, s in SENTENCES)
    assert words_of("The LICENCE, v2.0") == ["the", "license", "v2", "0"]
    assert scan.sentence_ids("I said it was released under the MIT License.") == []
    assert scan.sentence_ids("Released under the MIT License of our own making.") == []


def test_license_rules():
    scan = SentenceRules()
    assert scan.licenses(["apache2-use", "apache-copy", "apache-asis", "apache-see", None, "mit-line"]) == ["Apache-2.0", "MIT"]
    assert scan.licenses(["bsd-redistribute", "bsd-source", "bsd-binary"]) == ["BSD-2-Clause"] and scan.licenses([None, "asis"]) == []
    with pytest.raises(ValueError):
        SentenceRules(rules=(("X", ("nothing",)),))


def test_license_scan(spark, make, odd_rows):
    rows = [*odd_rows, (90, "Prose.\nReleased under the MIT License.\nReleased under the MIT Licence!")]
    got = scan_licenses(make(*rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["licenses"] for r in got if r["licenses"]} == {90: ["MIT", "MIT"]}
    assert scan_licenses(make()).count() == 0
    lines_of = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    expected = {k: ",".join(lines_of[x] for x in t.split("\n") if x in lines_of) for k, t in texts_of(spark)}
    assert {r["doc_id"]: r["licenses"] for r in QUERIES["op6_license_scan"](spark, SF).collect()} == expected


# --- 7 quality classifier --------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for k, r in got.items())
    tested = [(got[k]["predicted"], y) for k, y in labels.items() if k in got and got[k]["held_out"]]
    assert len(tested) > 80 and sum(p == y for p, y in tested) / len(tested) > 0.95
    assert sum(p for p, y in tested if y == 1) / sum(y for _, y in tested) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_quality_of_odd_rows(spark, make, odd_rows):
    docs = make(*odd_rows)
    labels = spark.createDataFrame([(5, 1), (6, 1), (6, 0), (7, 0), (8, None), (None, 1), (15, 0), (11, 1), (12, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(docs, model, least=0.0).count() == len(odd_rows) and quality.keep_good(docs, model).columns == docs.columns
    nothing = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5} and quality.score(make(), nothing).count() == 0
    only = quality.train(docs, spark.createDataFrame([(5, 1), (7, 1), (11, 1), (12, 1), (15, 1)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, only).collect()} == {1.0}


# --- 8 mixing -----------------------------------------------------------------------------------


def test_rake_meets_its_targets(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randrange(1, 500)) for a in range(5) for b in range(3) for c in range(3)], "source string, lang string, topic string, tokens long")
    goal = {"source": {f"s{i}": 0.2 for i in range(5)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    got = mixing.rake(cells, 1.0, 12, goal).collect()
    total = sum(r["tokens"] * r["weight"] for r in got)
    for dim, wanted in goal.items():
        for value, share in wanted.items():
            assert sum(r["tokens"] * r["weight"] for r in got if r[dim] == value) / total == pytest.approx(share, abs=1e-6)
    kept = mixing.calibrate(mixing.rake(cells, 0.7, 8, {}), 0.9, 4).collect()
    assert sum(r["tokens"] * r["probability"] for r in kept) / sum(r["tokens"] for r in kept) == pytest.approx(0.9, abs=0.02) and all(0 <= r["probability"] <= 1 for r in kept)


def test_sample_meets_its_targets(make):
    rng = random.Random(8)
    topics = ("a | b", "who?", "plain words here")
    docs = [(k, rng.choices(topics, (1, 2, 5))[0], rng.choices("abc", (1, 3, 8))[0], rng.choices("xyz", (1, 2, 6))[0]) for k in range(4000)]
    rows = [r.asDict() for r in mixing.mix_sources(make(*docs, extra=False), keep=None).collect()]
    total = sum(r["_tokens"] for r in rows)
    for dim in ("source", "lang", "_topic"):
        seen, expected, selected = Counter(), Counter(), Counter()
        for r in rows:
            seen[r[dim]] += r["_tokens"]
            expected[r[dim]] += r["_tokens"] * r["_probability"]
            selected[r[dim]] += r["_tokens"] * r["_selected"]
        goal = {k: (v / total) ** 0.7 for k, v in seen.items()}
        for k, v in goal.items():
            share = v / sum(goal.values())
            assert expected[k] / sum(expected.values()) == pytest.approx(share, abs=1e-4)
            assert selected[k] / sum(selected.values()) == pytest.approx(share, abs=0.03)
    assert max(r["_probability"] for r in rows) == pytest.approx(1)


def test_mixing_of_odd_rows(make, odd_rows):
    df = make(*odd_rows)
    for how in ({}, {"broadcast_cells": 0}, {"targets": {"lang": {"en": 1.0}}}):
        got = mixing.mix_sources(df, **how)
        assert got.columns[: len(df.columns)] == df.columns and got.count() == len(odd_rows)
        assert all(r["_selected"] == (int(hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32 < r["_probability"]) for r in got.collect())
    assert mixing.mix_sources(make()).count() == 0


# --- 9 fingerprints -------------------------------------------------------------------------------


def shingles(text):
    w = re.split(r"[\x20\x09-\x0D]+", text.lower())
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprint_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_scaled_fingerprint"](spark, SF).collect()}
    docs = sorted(texts_of(spark), reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors, same = [], defaultdict(set)
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(r["near_edited"] - like(shingles(text), shingles(edited))))
        assert abs(r["near_next"] - like(shingles(text), shingles(following))) < 0.35
        same[text].add(r["fingerprint"])
    assert sum(errors) / len(errors) < 0.08 and all(len(v) == 1 for v in same.values())
    assert len({v for x in same.values() for v in x}) == len(same)


def test_fingerprints_of_odd_rows(make, odd_rows):
    got = fingerprints.edit_fingerprints(make(*odd_rows)).collect()
    assert len(got) == len(odd_rows) and all((len(r["sketch"]) > 0) == bool(words(r["text"])) for r in got)
    alone = fingerprints.edit_fingerprints(make((5, "abcdef"))).first()
    assert alone["edited"] == "abcdab" and fingerprints.edit_fingerprints(make()).count() == 0


def test_sketch_algebra(spark):
    rng = random.Random(8)
    a, b = [[f"x{rng.randrange(10**6)}" for _ in range(n)] for n in (3000, 400)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[100:400]), " ".join(a + b))], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_sketch(df, c, f"s{c}")
    r = df.select(fingerprints.containment("sb", "sa").alias("inside"), fingerprints.containment("sa", "sb").alias("outside"), fingerprints.likeness("sa", "sc").alias("like"), fingerprints.merged("sa", "sb").alias("m"), "sa").first()
    assert r["inside"] > 0.95 and r["outside"] == pytest.approx(0.1, abs=0.04) and r["like"] == pytest.approx(3000 / 3400, abs=0.05) and set(r["sa"]) <= set(r["m"])


def test_neighbours_over_many_ranges(spark):
    ids = sorted(random.Random(6).sample(range(-(10**6), 10**6), 500))
    df = spark.createDataFrame([(k, abs(k) % 97, 1) for k in ids], "doc_id long, n int, times long")
    found, repeated = fingerprints.neighbours(df, least_rows=7)
    expected = {k: ids[(bisect.bisect_right(ids, k)) % len(ids)] for k in ids}
    assert not repeated and {r["doc_id"]: r["before"] for r in found.collect()} == expected


# --- 10 packing ---------------------------------------------------------------------------------------


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    rows = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    ids = {k: [*model.encode(t, add_special_tokens=False).ids, 0] for k, t in texts_of(spark)}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert Counter(r["doc_id"] for r in rows) == {k: -(-len(v) // 2048) for k, v in ids.items()}
    assert check_packed(rows, 2048) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_packing_of_special_tokens(make):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "é<|endoftext|>\u00a0É 😀", "<|END|> <|endoftext | <|EndOfText|>", "it's<|endoftext|>'s"]
    assert model.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    rows = packing.pack_documents(make(*enumerate(texts)), tokenizer_path(), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: [*model.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_hierarchical_packing(spark):
    rng = random.Random(1)
    lengths = [rng.choice([rng.randrange(1, 40), rng.randrange(1, 100)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    placed = packing.pack(items, 100, task_items=300).join(items, "item").collect()
    assert len(placed) == 3000 and check_packed(placed, 100) <= 1.03 * sum(lengths) / 100 + 1
    alone = packing.pack(spark.createDataFrame([(i, 60) for i in range(50)], "item long, length long"), 100, task_items=10).collect()
    assert len({r["sequence_id"] for r in alone}) == 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins = packing.best_fit(np.array(lengths, np.int64), 50)
    fill = Counter()
    for b, n in zip(bins.tolist(), lengths):
        fill[b] += n
    assert all(v <= 50 for v in fill.values()) and len(fill) <= 1.7 * -(-sum(lengths) // 50) + 1


def test_packing_of_odd_rows(make, odd_rows):
    rows = packing.pack_documents(make(*odd_rows), tokenizer_path(), with_ids=True).collect()
    check_packed(rows, 2048)
    assert {r["doc_id"] for r in rows} == {k for k, *_ in odd_rows} and all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["piece"] == 0 for r in rows) == len(odd_rows) and [r["ids"] for r in rows if r["doc_id"] == 1] == [[0]]
    assert packing.pack_documents(make(), tokenizer_path()).count() == 0


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "quarry")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "quarry.llm" not in open(os.path.join(folder, f)).read(), f

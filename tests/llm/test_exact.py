"""Operators against second implementations of their methods, and at the edges of their sizes."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import fingerprints, jaccard, mixing, packing, quality, tiff
from quarry.llm.licenses import SentenceRules, scan_licenses
from quarry.llm.queries import QUERIES, SHARDS

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*values):
    """xxhash64 of columns: strings, longs and arrays of longs, each seeded with the hash before it."""
    h = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            raw = x.encode() if isinstance(x, str) else x if isinstance(x, bytes) else struct.pack("<q", x)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return signed(h)


# --- 1 Jaccard join --------------------------------------------------------------------


def test_rows_of_one_id_have_one_component(make):
    base, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, base), (9, base + " x"), (9, other), (12, other + " y"), (20, "all alone here"), (12, "one more text of its own"), (None, base + " z"), (None, "no id and no link")]
    got = jaccard.jaccard_join(make(*rows)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert {k: v for k, v in parts.items() if k is not None} == {1: {1}, 9: {1}, 12: {1}, 20: {20}} and parts[None] == {1, None}


@pytest.mark.parametrize("drawn", [2, 16])
def test_lists_of_many_components(spark, drawn):
    """One key that many sets share, few of which are linked: every pair is compared in the end."""
    rng = random.Random(4)
    sets = {}
    for g in range(30):
        core = [1, *(1000 * g + i for i in range(2, 12))]
        for k in range(3):
            sets[100 * g + k] = sorted(set(core) | {10**6 + rng.randrange(10**6) for _ in range(k)})
    reps = spark.createDataFrame([(k, str(k).encode(), len(v), v, [2] * len(v)) for k, v in sets.items()], "node long, sig binary, n long, toks array<long>, freq array<int>")
    entries = spark.createDataFrame([(1, k, len(v), 0, 10**6) for k, v in sets.items()], "key long, node long, n long, own long, most long")
    got = {r["node"]: r["comp"] for r in jaccard._links(reps, entries, 3, 4, drawn).collect()}
    linked = lambda a, b: 7 * len(set(a) & set(b)) >= 3 * (len(a) + len(b))
    low = {k: k for k in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if linked(sets[a], sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert {k: got.get(k, k) for k in sets} == low and len(set(low.values())) == 30


# --- 4 media ---------------------------------------------------------------------------------


@pytest.mark.parametrize("form", tiff.FORMS)
def test_long_texts_in_every_form(form):
    rng = random.Random(6)
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10_000)) for _ in range(30_000)).encode()
    noise = rng.randbytes(40_000)
    for raw in (prose, noise, b"a" * 100_000, b""):
        payload = tiff.payload_of(raw)
        pages = list(tiff.decode_tiff(tiff.store(payload, [form])))
        assert b"".join(p.tobytes() for _, _, p in pages) == payload and {how for how, _, _ in pages} == {form[0]}


def test_forms_are_picked_at_every_size():
    rng = random.Random(7)
    picked = {size: {next(tiff.decode_tiff(tiff.store(tiff.payload_of(rng.randbytes(size)))))[:2] for _ in range(60)} for size in (100, 1000, 20_000)}
    assert all(len(v) == 6 for v in picked.values())
    assert tiff.store(tiff.payload_of(b"same")) == tiff.store(tiff.payload_of(b"same"))


def page_file(tags, pixels, end="<"):
    at = 8 + len(pixels)
    body = struct.pack(end + "H", len(tags))
    tail, beyond = b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"{end}{len(values)}{ {3: 'H', 4: 'I'}[kind]}", *values)
        if len(raw) > 4:
            raw, tail = struct.pack(end + "I", beyond + len(tail)), tail + raw
        body += struct.pack(end + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", at) + pixels + body + b"\0\0\0\0" + tail


def test_depths_planes_and_bit_order():
    base = [(256, 3, [4]), (257, 3, [2])]
    four = page_file([*base, (258, 3, [4]), (273, 4, [8]), (279, 4, [4])], b"\x12\x34\x56\x78")
    assert list(tiff.decode_tiff(four))[0][2].tolist() == [[1, 2, 3, 4], [5, 6, 7, 8]]
    one = page_file([*base, (258, 3, [1]), (266, 3, [2]), (273, 4, [8]), (279, 4, [2])], b"\x05\x08")
    assert list(tiff.decode_tiff(one))[0][2].tolist() == [[1, 0, 1, 0], [0, 0, 0, 1]]
    for end in "<>":
        wide = page_file([*base, (258, 3, [16]), (273, 4, [8]), (279, 4, [16]), (317, 3, [2])], struct.pack(end + "8H", 300, 1, 1, 1, 500, 0, 0, 65535), end)
        assert list(tiff.decode_tiff(wide))[0][2].tolist() == [[300, 301, 302, 303], [500, 500, 500, 499]]
    planes = page_file([*base, (258, 3, [8, 8]), (273, 4, [8, 16]), (277, 3, [2]), (279, 4, [8, 8]), (284, 3, [2])], bytes(range(16)))
    assert list(tiff.decode_tiff(planes))[0][2].tolist() == [[0, 8, 1, 9, 2, 10, 3, 11], [4, 12, 5, 13, 6, 14, 7, 15]]


def test_hostile_files(spark):
    size = lambda **t: page_file([(256, 4, [t.get("w", 4)]), (257, 4, [t.get("h", 2)]), (258, 3, [8]), (259, 3, [t.get("how", 1)]), (273, 4, [8]), (278, 4, [t.get("rows", 2)]), (279, 4, [8])], bytes(8))
    assert list(tiff.decode_tiff(size()))[0][2].tolist() == [[0] * 4] * 2
    bad = [size(rows=0), size(w=0), size(w=2**31, h=2**31), size(w=2**20, h=2**10, how=5), size(how=99)]
    for data in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.decode_tiff(data))
    rows = spark.createDataFrame([(k, 3, d) for k, d in enumerate([*bad, None, size()])], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in tiff.media_features(rows).collect()}
    assert len(got) == 7 and got[6]["payload_bytes"] == 8 and got[5]["media_bytes"] is None and all(got[k]["payload_sha256"] is None and got[k]["media_bytes"] == len(bad[k]) for k in range(5))


# --- 5 sharding ----------------------------------------------------------------------------------


def test_sharding_by_hand(spark):
    slots = 65_537
    turns = []
    for name in SHARDS:
        offset, skip = zlib.crc32(f"offset:{name}".encode()) % slots, zlib.crc32(f"skip:{name}".encode()) % (slots - 1) + 1
        turns.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(turns):
            free = next((x for x in order if x not in owner), None)
            if free is not None:
                owner[free] = shard
    docs = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    slot = {k: spark_hash(str(k)) % slots for k in docs}
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in QUERIES["op5_table_sharding"](spark, SF).collect()}
    assert got == {k: (s, owner[s]) for k, s in slot.items()}


# --- 6 licenses --------------------------------------------------------------------------------


def test_long_separators_after_a_sentence():
    scan = SentenceRules()
    for gap in (" " * 80, "-" * 80, " \t" * 5000):
        assert scan.sentence_ids(f"All rights reserved{gap}\nmore") == ["rights-reserved"] and scan.sentence_ids(f"All rights reserved{gap}x") == []
    assert scan.sentence_ids("All rights reserved" + "*" * 90 + ".") == ["rights-reserved"]


def test_knowledge_as_tables(spark, make):
    sentences = spark.createDataFrame([("a", "Use it as you like"), ("b", "Give it back")], "identifier string, sentence string")
    rules = spark.createDataFrame([(2, "Half", ["a"]), (1, "Whole", ["a", "b"])], "place int, license string, identifiers array<string>")
    got = scan_licenses(make((1, "Use it as you like.\nGive it back!"), (2, "Use it as you like"), (3, None)), sentences=sentences, rules=rules).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {1: ["Whole"], 2: ["Half"], 3: []}
    whole = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    assert SentenceRules().licenses(SentenceRules().sentence_ids(whole)) == ["0BSD"]


# --- 7 quality classifier ------------------------------------------------------------------------


def grams(text):
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\t\n\x0b\x0c\r ]+", text.encode())
    repeated = [name for name, period, length in (("aa", 1, 2), ("aaa", 1, 3), ("abab", 2, 4)) if any(all(tokens[i + j] == tokens[i + j + period] for j in range(length - period)) for i in range(len(tokens) - length + 1))]
    return set(tokens) | set(zip(tokens, tokens[1:])) | set(repeated)


def test_quality_against_plain_descent(spark, make):
    """The same model from n-grams as they are, without hashing, in plain Python."""
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(25)], [f"bad{i}" for i in range(25)]
    rows, y = [], {}
    for k in range(90):
        y[k] = rng.randrange(2)
        own = rng.choices(good if y[k] else bad, k=rng.randrange(4, 16)) + rng.choices(good + bad, k=4) + ["!!"] * rng.randrange(3)
        rows.append((k, " ".join(rng.sample(own, len(own)))))
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    model = quality.train(make(*rows), labels, epochs=4000)
    got = {r["doc_id"]: r["score"] for r in quality.score(make(*rows), model).collect()}

    fitted = [(grams(t), y[k]) for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    width = 2**18
    count = [Counter(g for f, label in fitted if label == c for g in f) for c in (0, 1)]
    total = [sum(c.values()) + width for c in count]
    ratio = lambda g: np.log((count[1][g] + 1) / total[1] / ((count[0][g] + 1) / total[0]))
    unit = lambda f: {g: ratio(g) / np.sqrt(sum(ratio(x) ** 2 for x in f)) for g in f}
    x, sign = [unit(f) for f, _ in fitted], [1 if label else -1 for _, label in fitted]
    ones = sum(s > 0 for s in sign)
    most = [len(sign) / (2 * (ones if s > 0 else len(sign) - ones)) for s in sign]
    w, bias, alpha = Counter(), 0.0, [0.0] * len(x)
    for _ in range(4000):
        moved = 0.0
        for i, v in enumerate(x):
            new = min(max(alpha[i] - (sign[i] * (sum(w[g] * a for g, a in v.items()) + bias) - 1) / 2, 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            alpha[i], moved = new, max(moved, abs(step))
            bias += step
            for g, a in v.items():
                w[g] += step * a
        if moved < 1e-6:
            break
    for k, t in rows:
        margin = sum(w[g] * a for g, a in unit(grams(t)).items()) + bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=2e-3)


def test_fitted_rows_are_bounded(spark, make):
    """Repeated ids do not add rows to the fit: the smallest text of each counts."""
    rows = [(k, f"text number {k % 7} of {'this' if k % 2 else 'that'} kind") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    once, often = (quality.train(make(*x), labels, max_rows=20) for x in (rows, rows + [(k, t + " zzz") for k, t in rows] * 5))
    assert (once.weight == often.weight).all() and once.bias == often.bias


# --- 8 mixing -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", [{}, {"keep": None}, {"targets": {"lang": {"x": 0.5, "y": 0.5}}}, {"keep": 0.4, "rounds": 3, "steps": 2}, {"rounds": 0, "steps": 0}])
def test_one_row_and_many_tables_agree(make, how):
    rng = random.Random(8)
    docs = make(*((k, " ".join(["w"] * rng.randrange(0, 30)), rng.choices("xyz", (1, 2, 6))[0], rng.choice("abcd")) for k in range(300)), extra=False)
    topic = F.when(F.col("doc_id") % 3 == 0, "even").when(F.col("doc_id") % 3 == 1, "odd")
    one, many = ({r["doc_id"]: (r["_topic"], r["_weight"], r["_probability"]) for r in mixing.mix_sources(docs, topic=topic, broadcast_cells=n, **how).collect()} for n in (100, 0))
    assert {t for t, *_ in one.values()} == {"even", "odd", "∅"} and one.keys() == many.keys()
    assert all(one[k][1:] == pytest.approx(many[k][1:], rel=1e-9) for k in one)


# --- 9 fingerprints ---------------------------------------------------------------------------------------


def sketch(text, fraction=4):
    w = [spark_hash(x) for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    top = -(2**63) + 2**64 // fraction
    if len(w) >= 5:
        hashes = {spark_hash(w[i : i + 5]) for i in range(len(w) - 4)}
    else:
        hashes = {spark_hash(struct.pack("<i", len(w)), w)} if w else set()
    return {h for h in hashes if h < top} or ({min(hashes)} if hashes else set())


def test_fingerprints_by_hand(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op9_scaled_fingerprint"](spark, SF).collect()}
    text_of = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in sorted(s))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(docs)
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        own, changed, beyond = sketch(text), sketch(edited), sketch(following)
        r = got[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(own), text_of(changed))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(own, changed), like(own, beyond)))


def test_fingerprints_read_back(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, ""), (3, "a b c")], "i int, t string")
    made = fingerprints.with_sketch(df, "t", "s").withColumn("f", fingerprints.encoded("s"))
    assert all(r["s"] == r["back"] for r in made.select("s", fingerprints.decoded("f").alias("back")).collect())


def test_a_null_id_fills_no_range(spark):
    ids = [-(2**63), *range(1000, 3000), 2**62]
    df = spark.createDataFrame([(k, 3, 1) for k in ids], "doc_id long, n int, times long")
    found, _ = fingerprints.neighbours(df, least_rows=100)
    assert {r["doc_id"]: r["before"] for r in found.collect()} == dict(zip(ids, ids[1:] + ids[:1]))
    ranged = df.repartitionByRange(20, "doc_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranged < 400


# --- 10 packing ------------------------------------------------------------------------------------------


def test_pieces_that_cannot_be_merged(spark, monkeypatch):
    rounds = []
    packed = packing._round
    monkeypatch.setattr(packing, "_round", lambda *a: rounds.append(a) or packed(*a))
    items = spark.createDataFrame([(i, 60) for i in range(1500)], "item long, length long")
    placed = packing.pack(items, 100, task_items=10).collect()
    assert len(rounds) <= 3 and len({r["sequence_id"] for r in placed}) == 1500 and {r["offset"] for r in placed} == {0}


def test_numbers_of_bins_stay_apart(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, rng.randrange(1, 30)) for i in range(4000)], "item long, length long")
    lengths = {r["item"]: r["length"] for r in items.collect()}
    fill = Counter()
    for r in packing.pack(items, 100, task_items=100, least_gain=0.0).collect():
        fill[r["sequence_id"]] += lengths[r["item"]]
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(lengths.values()) and len(fill) <= 1.05 * sum(lengths.values()) / 100 + 2

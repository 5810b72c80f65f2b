"""The prefix trie against sequences compared whole, on tables, random and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quarry.llm import trie
from quarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string"
SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    for conv in by:
        by[conv] = [(k[2], k[4]) for k in sorted(by[conv])]
    rebuilt = {}
    for conv in by:
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - int(conv / 20) * 20 if conv < 0 else conv % 20
        rebuilt[conv] = tuple(by.get(conv - base, [])[:h] + by[conv][h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    for path, who in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", path[-1][1].encode())) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(who) - 1) * words
    return sorted(
        (
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(path)).encode()).hexdigest(),
        )
        for path, who in members.items()
    )


def built(df):
    return sorted(tuple(r) for r in trie.conversation_trie(df).select(*SHOWN).collect())


def test_query_equals_whole_sequences_and_sql(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_conversation_trie"](spark, SF).select(*SHOWN).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(con.sql(ORACLES["op12_conversation_trie"]).select(",".join(SHOWN)).fetchall()) == got


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations_share_beginnings(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-45, 400), 150):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", rng.choice(["a b", "a  b c", "c"])))
    rng.shuffle(rows)
    assert built(spark.createDataFrame(rows, COLUMNS).repartition(3)) == brute(rows)


def test_one_long_conversation_and_a_large_group_of_copies(spark):
    rows = [(100, k, "user", f"turn {k % 7}") for k in range(300)]
    rows += [(conv, k, "user", f"same {k}") for conv in range(1000, 2200) for k in range(3)]
    rows += [(conv, 0, "user", f"own {conv}") for conv in range(3000, 4300)]
    got = built(spark.createDataFrame(rows, COLUMNS))
    assert got == brute(rows)
    assert max(r[1] for r in got) > 290


def test_busy_nodes_meet_their_children_by_broadcast(spark, monkeypatch):
    # with few nodes only those of over 1000 children are busy: the root of these is
    rows = [(conv, k, "user", f"own {conv}") for conv in range(1, 1500) for k in range(5)]
    assert built(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, None, "a"), (0, 2, "user", "tie"), (0, 2, "user", "tie"), (3, 0, "user", ""), (5, None, "x", " \t"),
        (None, 0, "user", "belongs to none"), (20, 0, "user", "x" * 300_000), (27, 5, "user", "é 😀"), (27, 5, "user", "é 😀"), (2**62, 0, "user", "far"), (-7, 0, "user", "below"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", b"y", 2) for r in rows], COLUMNS + ", i int, digest string, parent binary, depth int")
    assert built(df) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    conv = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "its only turn is in the head that is replaced, by none")]
    assert built(spark.createDataFrame(rows, COLUMNS)) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_empty_tables(spark):
    assert built(spark.createDataFrame([], COLUMNS)) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], COLUMNS)) == []
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    assert con.sql(ORACLES["op12_conversation_trie"]).fetchall() == []

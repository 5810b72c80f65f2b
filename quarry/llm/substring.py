"""Substring dedup: every window of ``width`` words is hashed and counted, and
repeated windows merge into maximal intervals of words to remove.

Plan. Documents are dealt by a hash of doc_id to groups of a few MB (the only
shuffle of text; both uses of it share one exchange). Each group hashes all its
windows, keeps each hash once with the document it occurs in first, and sends
them packed, one row per hash bucket, so that a passage found in a third of all
documents travels once per group, not once per document. A bucket finds for
every hash the smallest document over all groups and answers each group with a
bit per hash sent. The group then marks windows, merges them and cuts.

Buckets are numbered by a second hash, independent of the 64 bits that are
compared, and their number grows with the input, as that of the groups does.

Defined results: a null or empty text has no words; a text shorter than the
window keeps all its words; a null doc_id sorts after all others; rows that
share a doc_id count as one document in the order of their texts; an empty table gives
no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import hashing
from quarry.llm.common import grouped_text, keyed_text, text_bytes

_LAST = np.iinfo(np.int64).max
_FIRST_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,stop:int>>"


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs; the width goes first."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 2 ** (8 * int(k[2])))
    return kind[2].encode() + values.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1)


class _Group:
    """The windows of one group, in the order of (doc_id, start)."""

    def __init__(self, table: pa.Table, width: int, buckets: int) -> None:
        ids = hashing.column(table, "doc_id")
        texts = hashing.column(table, "text")
        order = np.lexsort((np.arange(len(ids)), ids.fill_null(_LAST).to_numpy(zero_copy_only=False)))
        keys = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[order]
        if len(keys) > 1 and (keys[1:] == keys[:-1]).any():
            known = texts.to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i].as_py() is None, ids[i].as_py() or 0, known[i])))
        self.ids, self.texts = ids.take(pa.array(order)), texts.take(pa.array(order))
        raw, at = hashing.text_buffer(self.texts)
        starts, ends, self.first_word = hashing.word_spans(raw, at)
        words = hashing.span_hashes(raw, starts, ends)
        self.n_words = np.diff(self.first_word)
        owner = hashing.owners(self.n_words)
        hashes = hashing.rolling(words, width, _FIRST_BASE)
        inside = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        #: by window: the word it starts at, its hash, whether the group has it earlier
        self.start, self.hash = inside, hashes[inside]
        _, first = np.unique(self.hash, return_index=True)
        self.again = np.ones(len(inside), bool)
        self.again[first] = False
        first.sort()
        second = hashing.rolling(hashing.mix(words ^ np.uint64(_SECOND_BASE)), width, _SECOND_BASE)
        bucket = (second[inside[first]] % np.uint64(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        #: windows to ask about, bucket by bucket
        self.asked, self.bucket = first[dealt], bucket[dealt]
        self.doc = self.ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[owner[inside[self.asked]]] if len(inside) else np.zeros(0, np.int64)

    def parts(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) within what is asked."""
        if not len(self.bucket):
            return []
        cut = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)]))
        return [(int(self.bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 20,
    group_bytes: int = 2 << 20,
    bucket_windows: int = 400_000,
) -> DataFrame:
    """One row per document: its words, how many go, the text of those that stay
    (joined by one space) and the intervals of words removed."""
    keyed = keyed_text(docs, id_col, text_col)
    total = text_bytes(keyed)
    buckets = max(1, total // 6 // bucket_windows)
    grouped = grouped_text(keyed, total, group_bytes)

    def ask(key, table):
        group = _Group(table, width, buckets)
        rows = []
        for bucket, a, b in group.parts():
            doc = group.doc[a:b]
            steps = np.diff(doc.view(np.uint64), prepend=doc[:1].view(np.uint64))
            rows.append((key[0].as_py(), bucket, group.hash[group.asked[a:b]].tobytes(), int(doc[0]), _packed(steps)))
        return pa.table(list(zip(*rows)) or [[]] * 5, schema=asked_schema)

    asked_schema = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("base", pa.int64()), ("steps", pa.binary())])
    asked = grouped.groupBy("grp").applyInArrow(ask, "grp long, bucket long, hashes binary, base long, steps binary")

    def answer(table):
        hashes, docs_, sizes = [], [], []
        for h, base, steps in zip(*(table.column(c).to_pylist() for c in ("hashes", "base", "steps"))):
            hashes.append(np.frombuffer(h, np.uint64))
            docs_.append(np.cumsum(_unpacked(steps), dtype=np.uint64).view(np.int64) + base)
            sizes.append(len(hashes[-1]))
        h, d = np.concatenate(hashes), np.concatenate(docs_)
        order = np.lexsort((d, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        cut = np.concatenate(([0], np.cumsum(sizes)))
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return pa.table([table.column("grp"), table.column("bucket"), pa.array(bits, pa.binary())], names=["grp", "bucket", "bits"])

    answered = asked.groupBy("bucket").applyInArrow(answer, "grp long, bucket long, bits binary")

    def cut(texts, answers):
        group = _Group(texts, width, buckets)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        again = group.again
        for bucket, a, b in group.parts():
            again[group.asked[a:b]] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
        total_words = int(group.first_word[-1])
        edge = np.zeros(total_words + 1, np.int64)
        np.add.at(edge, group.start[again], 1)
        np.add.at(edge, group.start[again] + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, kept, runs = [], [], []
        for i, text in enumerate(group.texts):
            a, b = group.first_word[i], group.first_word[i + 1]
            mask = gone[a:b]
            words = text.as_py().encode().split()
            removed.append(int(mask.sum()))
            if removed[-1]:
                turn = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                runs.append([{"start": int(s), "stop": int(e)} for s, e in zip(turn[::2], turn[1::2])])
                words = [words[k] for k in np.flatnonzero(~mask)]
            else:
                runs.append([])
            kept.append(b" ".join(words).decode())
        return pa.table(
            [group.ids, pa.array(group.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
             pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
        )

    return grouped.groupBy("grp").cogroup(answered.groupBy("grp")).applyInArrow(cut, RESULT)

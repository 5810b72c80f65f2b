"""Best-fit packing of token pieces into sequences, hierarchically.

Tokenizing runs over Arrow batches, word by word with a bounded table of known
words. Its small result (a row per piece, no ids) is settled in the checkpoint
folder. Then each partition packs its pieces best-fit, emits bins that are
nearly full, and passes on its other bins as items; partitions of such items are
merged, a few at a time, and packed again, until one partition holds what is
left or a round lowers the number of underfull bins by less than ``least_gain`` of
them (bins over half full cannot be merged, however many there are). Partitions
are as many as ``task_items`` lengths a task ask for, dealt by a hash, so the tree
grows with the input and its tasks do not.

Defined results: a null text is an empty one, which packs as its single end id;
an empty table gives no rows; repeated rows are packed as documents of their
own; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import keyed_text, settle, shuffle_partitions

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = pa.list_(pa.int32())
#: Words that a Python worker keeps the ids of: the more, the fewer are encoded again.
KNOWN_WORDS = 1_200_000


class WordTokens:
    """Ids of texts through a table of their words, in numpy.

    White space separates tokens for good in this vocabulary (it is dropped, and
    normalization does not reach across it), so a text's ids are its words' ids
    in turn. Words are known by a 64-bit hash and their length; a word takes some
    40 bytes. The table outlives a task in its Python worker and is emptied when
    it holds ``limit`` words."""

    _of: dict[str, "WordTokens"] = {}

    def __init__(self, path: str, limit: int = KNOWN_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._limit = limit
        self._clear()

    @classmethod
    def of(cls, path: str, limit: int) -> "WordTokens":
        if path not in cls._of:
            cls._of[path] = cls(path, limit)
        cls._of[path]._limit = limit
        return cls._of[path]

    def _clear(self) -> None:
        self._count = self._used = 0
        #: open addressing: the hash in each slot (0: free), and which word it is
        self._keys, self._word = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        #: by word: where its ids begin in the pool, and how many they are
        self._first, self._size, self._pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 17, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The word of each hash, -1 if not known."""
        mask = np.uint64(len(self._keys) - 1)
        out = np.full(len(hashes), -1, np.int32)
        left, slot, wanted = np.arange(len(hashes)), (hashes & mask).astype(np.int64), hashes
        while len(left):
            there = self._keys[slot]
            hit = there == wanted
            out[left[hit]] = self._word[slot[hit]]
            on = ~hit & (there != 0)
            left, wanted, slot = left[on], wanted[on], (slot[on] + 1) & int(mask)
        return out

    def _place(self, hashes: np.ndarray, word: np.ndarray) -> None:
        """Puts distinct new hashes into free slots; of several that want one, one gets it at a time."""
        mask = len(self._keys) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = hashes[free]
            won = self._keys[slot] == hashes
            self._word[slot[won]] = word[won]
            hashes, word, slot = hashes[~won], word[~won], (slot[~won] + 1) & mask

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, size = array("I"), np.empty(len(words), np.int32)
        for lo in range(0, len(words), 2048):
            for k, coded in enumerate(self._model.encode_batch(words[lo : lo + 2048], add_special_tokens=False), lo):
                got = coded.ids
                size[k] = len(got)
                ids.extend(got)
        n, end = self._count + len(words), self._used + len(ids)
        while 5 * n > 3 * len(self._keys):
            known = self._keys != 0
            keys, word = self._keys[known], self._word[known]
            self._keys, self._word = np.zeros(2 * len(self._keys), np.uint64), np.zeros(2 * len(self._word), np.int32)
            self._place(keys, word)
        if n > len(self._first):
            self._first, self._size = np.resize(self._first, n + n // 2), np.resize(self._size, n + n // 2)
        if end > len(self._pool):
            self._pool = np.resize(self._pool, end + end // 2)
        self._pool[self._used : end] = np.frombuffer(ids, np.uint32) if len(ids) else 0
        self._first[self._count : n] = self._used + np.cumsum(size) - size
        self._size[self._count : n] = size
        self._place(hashes, np.arange(self._count, n, dtype=np.int32))
        self._count, self._used = n, end

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit numbers."""
        if self._count > self._limit:
            self._clear()
        raw, at = hashing.text_buffer(texts)
        starts, ends, first = hashing.word_spans(raw, at)
        hashes = hashing.mix(hashing.span_hashes(raw, starts, ends) ^ (ends - starts).astype(np.uint64))
        hashes[hashes == 0] = 1
        words = self._find(hashes)
        unknown = np.flatnonzero(words < 0)
        if len(unknown):
            new, which = np.unique(hashes[unknown], return_index=True)
            where = unknown[which]
            data = raw.tobytes()
            self._learn(new, [data[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            words[unknown] = self._find(hashes[unknown])
        n = self._size[words]
        before = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = self._pool[np.repeat(self._first[words] - before[:-1], n) + np.arange(before[-1])].tobytes()
        cut = (4 * before[first]).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


def token_pieces(keyed: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False, known_words: int = KNOWN_WORDS) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``row`` tells apart rows that share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokens.of(tokenizer_path, known_words)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                columns: list[list] = [[], [], [], [], [], [], []]
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), coder.encode(part.column(1))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        values = (doc, row, piece, start // 4, len(cut) // 4, zlib.crc32(cut), cut)
                        for c, v in zip(columns, values):
                            c.append(v)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _PIECES)]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(c, np.int32) for c in columns[6]], _IDS))
                names = _PIECES.names + (["ids"] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        hashing.release()

    numbered = keyed.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Items go by falling length, each into the fullest
    bin that it fits, over a list of bins by room left (room is at most
    ``capacity``, so the next fit is found in one word of bits)."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there is a bin with room r
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, k, made = capacity, made, made + 1
        bins[i] = k
        if room > n:
            by_room[room - n].append(k)
            some |= 1 << (room - n)
    return bins


def _round(items: DataFrame, capacity: int, first: int, stride: int) -> DataFrame:
    """Packs each partition of (item, length), of at most ``stride`` items; bins are
    numbered from ``first``, ``stride`` numbers a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [(b.column(0), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        item, length = pa.concat_arrays([g[0] for g in got]), np.concatenate([g[1] for g in got])
        # a partition's rows come in no fixed order, and a task may run again
        rank = np.lexsort((item.to_numpy(), -length))
        item, length = item.take(pa.array(rank)), length[rank]
        bins = best_fit(length, capacity)
        order = np.argsort(bins, kind="stable")
        sizes, owner = length[order], bins[order]
        before = np.cumsum(sizes) - sizes
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        offset = before - np.repeat(before[new], np.diff(np.append(new, len(owner))))
        fill = np.bincount(bins, weights=length).astype(np.int64)
        number = first + TaskContext.get().partitionId() * stride
        table = [item.take(pa.array(order)), pa.array(sizes), pa.array(owner + number), pa.array(offset), pa.array(fill[owner])]
        yield from pa.table(table, names=["item", "length", "bin", "offset", "fill"]).to_batches(50_000)

    return items.mapInArrow(run, "item long, length long, bin long, offset long, fill long")


def pack(
    pieces: DataFrame,
    capacity: int,
    nearly_full: float = 0.998,
    task_items: int = 400_000,
    fan_in: int = 8,
    least_gain: float = 0.05,
) -> DataFrame:
    """``pieces`` (settled; unique long ``item``, ``length``) with its sequence and offset."""
    left = pieces.count()
    if left == 0:
        return pieces.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    least, first, level = int(capacity * nearly_full), 0, 0
    parts = max(1, -(-left // task_items))
    items, placed = pieces.select("item", "length"), None
    while True:
        # another deal each round, so that bins meet others than before
        dealt = items.repartition(parts, F.xxhash64(F.lit(level), "item"))
        packed = settle(_round(dealt, capacity, first, left))
        # no fewer partitions than asked for, and numbers for as many again
        first += 2 * max(parts, shuffle_partitions(pieces.sparkSession)) * left
        level += 1
        # a placement is (item, sequence, offset); a later round moves whole bins
        here = packed.select("item", F.col("bin").alias("sequence_id"), "offset")
        if placed is None:
            placed = here
        else:
            moved = here.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("offset").alias("shift"))
            placed = placed.join(moved, "sequence_id", "left").select(
                "item",
                F.coalesce("to", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
            )
        items = packed.filter(F.col("fill") < least).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        before, left = left, items.count()
        if parts == 1 or left <= 1 or (level > 1 and left > (1 - least_gain) * before):
            return placed
        placed = settle(placed)
        parts = max(1, -(-left // task_items), -(-parts // fan_in))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    known_words: int = KNOWN_WORDS,
    **how,
) -> DataFrame:
    """Every piece of every document and its place in a sequence of ``capacity``
    ids; ``with_ids`` adds the ids themselves. ``known_words`` bounds the table of words in each
    Python worker (about 100 bytes a word) and changes no result."""
    pieces = settle(token_pieces(keyed_text(docs, id_col, text_col), tokenizer_path, capacity, end_id, with_ids, known_words).withColumn("item", F.monotonically_increasing_id()))
    whole = F.col("length") == capacity
    short = pieces.filter(~whole)
    placed = pack(short.select("item", "length"), capacity, **how)
    full = pieces.filter(whole).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(full), "item").drop("item", "row")

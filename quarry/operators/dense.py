"""Exact nearest neighbours by cosine, many questions in one job.

Up to a block of questions is broadcast as a matrix: a bounded size, checked
first. More questions never pass through the driver: they are dealt by a hash to blocks,
each vector goes once to every block, and a task reads the questions of a block and then
its vectors, in order, as a stream. Either way vectors meet questions in slices of so
many rows that their product is bounded, a task keeps its best ``k`` per question,
and a window over those picks the overall best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions that a block holds on average at most, and numbers in a product of a slice and a block.
BLOCK, PRODUCT = 4096, 1 << 22


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * dims:
        raise ValueError(f"every vector must have {dims} dimensions")
    return values.reshape(-1, dims).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    if not np.isfinite(size).all() or (size == 0).any():
        raise ValueError("a vector must be finite and not zero")
    return m / size


class Best:
    """The ``k`` nearest of each question so far, by falling cosine and rising id. What comes
    in is measured against the least cosine that can still matter, and sorted once there is enough of it."""

    def __init__(self, qids: np.ndarray, matrix: np.ndarray | None, k: int, places: int) -> None:
        self.qids, self.matrix, self.k, self.places = qids, matrix, k, places
        self.bar = np.full(len(qids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(64, PRODUCT // len(self.qids))
        for lo in range(0, len(ids), rows):
            now = np.round(self.matrix @ vectors[lo : lo + rows].T, self.places)
            near = now >= self.bar[:, None]
            if near.sum() > len(self.qids) * self.k and now.shape[1] > self.k:
                self.bar = np.maximum(self.bar, np.partition(now, now.shape[1] - self.k, axis=1)[:, now.shape[1] - self.k])
                near = now >= self.bar[:, None]
            q, v = np.nonzero(near)
            self.keep(q, ids[lo + v], now[q, v])

    def keep(self, q: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """Takes in candidates: places of questions, ids, and how near these are."""
        self.found.append((q, ids, values))
        self.held += len(q)
        if self.held > 4 * len(self.qids) * self.k + PRODUCT // 8:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, cosine = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -cosine, q))
        q, ids, cosine = q[order], ids[order], cosine[order]
        counts = np.bincount(q, minlength=len(self.qids))
        first = np.cumsum(counts) - counts
        kept = np.arange(len(q)) - first[q] < self.k
        full = np.flatnonzero(counts >= self.k)
        self.bar[full] = np.maximum(self.bar[full], cosine[first[full] + self.k - 1])
        self.found, self.held = [(q[kept], ids[kept], cosine[kept])], int(kept.sum())
        return self.found[0]

    def rows(self, id_col: str) -> pa.RecordBatch:
        q, ids, cosine = self.settle()
        return pa.RecordBatch.from_arrays([pa.array(self.qids[q]), pa.array(ids), pa.array(cosine)], names=["qid", id_col, "cosine"])


def knn(vectors: DataFrame, questions: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", qid_col: str = "qid", places: int = 6) -> DataFrame:
    """(qid, id_col, cosine, rank): the ``k`` nearest of each question, ties by id.
    Filter ``vectors`` first for a search within a collection."""
    if not 0 <= k <= 4096:
        raise ValueError("k must be 0 to 4096")
    asked = questions.select(F.col(qid_col).cast("long").alias("qid"), F.col(vector_col).alias("v"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    schema = f"qid long, `{id_col}` long, cosine double"
    blocks = -(-asked.count() // BLOCK)
    if not blocks or not k:
        return vectors.sparkSession.createDataFrame([], schema + ", rank long")
    found = _broadcast(rows, asked, k, id_col, schema, places) if blocks == 1 else _streamed(rows, asked, blocks, k, id_col, schema, places)
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _broadcast(rows: DataFrame, asked: DataFrame, k: int, id_col: str, schema: str, places: int) -> DataFrame:
    """The best of each partition for at most ``BLOCK`` questions."""
    table = asked.toArrow()
    first = table.column(1).combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    dims = len(first[0])
    shared = rows.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), _unit(_flat(first, dims))))

    def run(batches):
        best = Best(*shared.value, k, places)
        for batch in batches:
            best.add(batch.column(0).to_numpy(), _unit(_flat(batch.column(1), dims)))
        yield best.rows(id_col)

    return rows.mapInArrow(run, schema)


def _streamed(rows: DataFrame, asked: DataFrame, blocks: int, k: int, id_col: str, schema: str, places: int) -> DataFrame:
    """The best of each (block of questions, share of the vectors): a sorted partition holds the questions of
    a pair before its vectors. Shares are as many as give every task of a shuffle a pair."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-tasks // blocks))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(deal("qid", blocks).alias("block"), each(shares).alias("share"), F.lit(0).alias("kind"), F.col("qid").alias("id"), "v")
    right = rows.select(each(blocks).alias("block"), deal("id", shares).alias("share"), F.lit(1).alias("kind"), "id", "v")

    def run(batches):
        pair, best, questions = None, None, []
        for batch in batches:
            block, share, kind = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if pair != (block[lo], share[lo]):
                    if best:
                        yield best.rows(id_col)
                    pair, best, questions = (block[lo], share[lo]), None, []
                ids, dims = part.column(3).to_numpy(), len(part.column(4)[0])
                unit = _unit(_flat(part.column(4), dims))
                if not kind[lo]:
                    questions.append((ids, unit))
                elif questions:
                    best = best or Best(np.concatenate([q for q, _ in questions]), np.concatenate([m for _, m in questions]), k, places)
                    best.add(ids, unit)
        if best:
            yield best.rows(id_col)

    dealt = left.unionByName(right).repartition(max(tasks, blocks * shares), "block", "share").sortWithinPartitions("block", "share", "kind")
    return dealt.mapInArrow(run, schema)

"""Quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by its class log-count ratio, each document to
unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
Scores are the margins through a logistic curve fitted on the training margins.

Tokens are maximal runs of letters and digits (bytes above 127 count as letters)
or of other marks; n-grams of one and two tokens, and three patterns of repeated
tokens, are indicators in ``2**bits`` hashed columns. Training reads a sample of at
most ``max_rows`` labelled ids, drawn by a hash of the id, so it does not follow
file order, each with one text. Their features are settled, and one task fits
them; the driver sees the weights alone. Scoring is one pass of Arrow batches
over all rows, whole texts, with the weights as a fixed-size broadcast.

Labels are read from rows with crc32(id as text) mod 3 other than 1 alone; the
rest are held out. Only the text enters a score.

Defined results: a null or empty text has no n-grams and gets the curve's value
at margin bias, and is fitted as such if it is labelled; a null id is held out;
where labels repeat for an id the lowest counts, and where documents do, the
smallest text is fitted and every row is scored; null labels are no labels; without labels of both classes every score is
that class's label (0.5 without any); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import keyed_text, settle, small_batches

_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_BASE = 0xD6E8FEB86659FD93


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram columns of all texts, text after text, and how many each has."""
    raw, at = hashing.text_buffer(texts)
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cut = np.flatnonzero(edge)
    token = np.flatnonzero(kind[cut[:-1]] > 0)
    starts, ends = cut[:-1][token], cut[1:][token]
    first = np.searchsorted(starts, at)
    owner = hashing.owners(np.diff(first))
    one = hashing.span_hashes(raw, starts, ends)
    two = hashing.rolling(one, 2, _BASE)
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) > 1 else np.zeros(0, np.int64)
    mask = np.uint64((1 << bits) - 1)
    keys = [(owner << bits) | (one & mask).astype(np.int64), (owner[inside] << bits) | (two[inside] & mask).astype(np.int64)]
    # patterns of repetition are n-grams too, whatever the token: aa, aaa, abab
    for k, (period, length) in enumerate(((1, 2), (1, 3), (2, 4))):
        at_ = np.arange(max(0, len(one) - length + 1))
        same = owner[at_] == owner[at_ + length - 1]
        for back in range(length - period):
            same &= one[at_ + back] == one[at_ + back + period]
        keys.append(np.unique(owner[at_[same]]) << bits | k)
    keys = np.concatenate(keys)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & int(mask), np.bincount(keys >> bits, minlength=n)


@dataclass
class QualityModel:
    """``score = 1 / (1 + exp(-(slope * margin + shift)))``; margin = w . x / |r . x| + bias."""

    bits: int
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        owner = hashing.owners(counts)
        r = self.ratio[columns]
        norm = np.sqrt(np.bincount(owner, weights=r * r, minlength=len(counts)))
        dot = np.bincount(owner, weights=r * self.weight[columns], minlength=len(counts))
        return dot / np.maximum(norm, 1e-12) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = self.margins(*features(texts, self.bits))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def fit(columns: list[np.ndarray], labels: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 12, smoothing: float = 1.0) -> QualityModel:
    """The model of labelled documents, given each one's distinct n-gram columns."""
    width = 1 << bits
    constant = lambda p: QualityModel(bits, np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0, 0.0, float(p))
    if len(set(labels.tolist())) < 2:
        return constant(0 if not len(labels) else 500 if labels[0] else -500)
    counts = np.fromiter(map(len, columns), np.int64, len(columns))
    flat, owner = np.concatenate(columns), hashing.owners(counts)
    up = smoothing + np.bincount(flat[labels[owner] == 1], minlength=width)
    down = smoothing + np.bincount(flat[labels[owner] == 0], minlength=width)
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    norm = np.sqrt(np.bincount(owner, weights=ratio[flat] ** 2, minlength=len(columns)))
    y = np.where(labels == 1, 1.0, -1.0)
    # each class weighs the same in the loss
    share = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    rows = [(c, ratio[c] / max(n, 1e-12)) for c, n in zip(columns, norm)]
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    size = np.array([float(v @ v) for _, v in rows]) + 1.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            c, v = rows[i]
            slack = y[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - slack / size[i], 0.0), cost * share[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[c] += step * v
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    # the dual's last pass left w = sum alpha y x, x already scaled: fold the scaling into one weight
    model = QualityModel(bits, ratio, w, bias, 1.0, 0.0)
    margin = model.margins(flat, counts)
    model.slope, model.shift = _logistic(margin, labels)
    model.ratio, model.weight = ratio.astype(np.float32), w.astype(np.float32)
    return model


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps on smoothed targets, both
    classes weighing the same: the curve passes 0.5 where the margin separates them."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    share = np.where(labels == 1, 1 / ones, 1 / zeros)
    x = np.column_stack((margin, np.ones(len(margin))))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (share * (p - target)) + 1e-4 * np.array([beta[0] - 1, beta[1]])
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(id_col: str):
    """crc32(id as text) mod 3 = 1, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, max_rows: int = 4_000, **how) -> QualityModel:
    """A model of at most ``max_rows`` labelled documents that are not held out."""
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .filter("y IN (0, 1)").filter(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # rows that repeat an id count once: the bound is on rows, not on ids alone
    sample = keyed_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                columns, counts = features(part.column(1), bits)
                cut = np.cumsum(counts)[:-1]
                rows = [c.astype("<u4").tobytes() for c in np.split(columns, cut)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(rows, pa.binary())], names=["y", "columns"])

    def learn(batches):
        # rows come in no fixed order; the fit depends on it
        rows = sorted((c, y) for batch in batches for y, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        model = fit([np.frombuffer(c, "<u4").astype(np.int64) for c, _ in rows], np.array([y for _, y in rows], np.int64), bits, **how)
        curve = [model.bias, model.slope, model.shift]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (model.ratio.tobytes(), model.weight.tobytes())] + [pa.array([x], pa.float64()) for x in curve], names=["ratio", "weight", "bias", "slope", "shift"])

    found = settle(sample.mapInArrow(run, "y int, columns binary"))
    one = found.coalesce(1).mapInArrow(learn, "ratio binary, weight binary, bias double, slope double, shift double").first()
    return QualityModel(bits, np.frombuffer(one["ratio"], np.float32), np.frombuffer(one["weight"], np.float32), one["bias"], one["slope"], one["shift"])


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)), pa.float64())], names=["doc_id", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array(shared.value.scores(part.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)

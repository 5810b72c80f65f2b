"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of one to five code points of its lower-cased
words, word edges included, hashed to ``2**bits`` rows of an embedding table. The
mean of their embeddings goes through a linear layer and a softmax. Both are
trained together by stochastic gradient descent in numpy, in one executor task,
on at most ``max_rows`` texts shared evenly by the languages (drawn by a hash of the
text, each text once), whole and in short cuts, so that texts of a few words are
known too. A fifth of them is left out of the descent and calibrates: a temperature
for the probabilities, and two bounds for rejection (``accepted``): the lowest
probability at which at most ``error`` of the accepted are wrong, and a lowest share
of subwords that training has met, which texts of other languages fall under.

Scoring is one pass of Arrow batches over all rows and whole texts, in blocks of
bounded memory however long a text is. The model is of a fixed size and is
broadcast; where there are fewer languages than dimensions the two layers are
multiplied out beforehand, which changes no score.

Texts and languages are learned from rows with crc32(id as text) mod 4 other than 2
alone; the rest are held out. Only the text enters a prediction.

Defined results: a null text and a text without a letter are ``und`` with score 0,
not accepted; so is every text if nothing can be learned. A null id is held out.
A null language is not learned from; a text that is given several is learned as
each of them. With one learned language every other text is that language with
score 1. Rows that repeat are scored each; an empty table gives no rows; other
columns are ignored. At most ``max_langs`` languages, the commonest, are learned.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import settle, small_batches

UNKNOWN = "und"
ORDERS = 5
_BLOCK = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Characters of the cuts that are trained on beside the whole text.
CUTS = (12, 25, 50, 100, 200)
_RANGE = 1 << 40


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 0 for whatever is no letter, with a 0 before
    each text and at the end; and where each text's leading 0 is."""
    lower = [(t or "").lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in lower[:-1]]) if lower else np.zeros(0, np.int64)
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, 0), starts.astype(np.int64)


def subword_rows(codes: np.ndarray, lo: int, hi: int, bits: int):
    """For each order, the table row of the subword that starts at each position of
    [lo, hi); row ``2**bits`` where none does."""
    part = np.zeros(hi - lo + ORDERS - 1, np.uint64)
    seen = codes[lo : hi + ORDERS - 1]
    part[: len(seen)] = seen
    n, none = hi - lo, 1 << bits
    letter = part > 0
    hashed = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    whole = np.ones(n, bool)  # all but the first and last code points are letters
    for order in range(1, ORDERS + 1):
        last = letter[order - 1 : order - 1 + n]
        if order > 2:
            whole &= letter[order - 2 : order - 2 + n]
        hashed = (hashed ^ part[order - 1 : order - 1 + n]) * _STEP
        hashed ^= hashed >> np.uint64(29)
        valid = last if order == 1 else letter[:n] | last if order == 2 else whole
        row = ((hashed * _STEP) >> np.uint64(64 - bits)).astype(np.int64)
        yield np.where(valid, row, none)


def subword_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of one text and how often each occurs."""
    codes, _ = code_points([text])
    total = np.zeros((1 << bits) + 1, np.int64)
    for lo in range(0, len(codes), _BLOCK):
        for rows in subword_rows(codes, lo, min(lo + _BLOCK, len(codes)), bits):
            total += np.bincount(rows, minlength=len(total))
    found = np.flatnonzero(total[:-1])
    return found, total[found]


@dataclass
class LanguageModel:
    bits: int
    langs: list[str]
    #: embeddings of subwords, and which rows training has met
    embedding: np.ndarray
    met: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    @property
    def table(self) -> np.ndarray:
        """What a subword adds to its text's sums: its share of the logits (or its embedding), whether it is met, one."""
        if not hasattr(self, "_table"):
            folded = len(self.langs) <= self.embedding.shape[1]
            values = self.embedding @ self.weight.T if folded else self.embedding
            rows = np.column_stack((values, self.met, np.ones(len(values)))).astype(np.float32)
            self._folded, self._table = folded, np.vstack((rows, np.zeros(rows.shape[1], np.float32)))
        return self._table

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of each text, the share of its subwords that are met, how many it has."""
        codes, starts = code_points(texts)
        table = self.table
        sums = np.zeros((len(texts), table.shape[1]))
        step = max(1 << 12, _BLOCK // table.shape[1])
        for lo in range(0, len(codes) if len(texts) else 0, step):
            hi = min(lo + step, len(codes))
            values = np.zeros((hi - lo, table.shape[1]), np.float32)
            for rows in subword_rows(codes, lo, hi, self.bits):
                values += table[rows]
            first = int(np.searchsorted(starts, lo, side="right")) - 1
            last = int(np.searchsorted(starts, hi, side="left"))
            at = np.maximum(starts[first:last] - lo, 0)
            sums[first:last] += np.add.reduceat(values, at, axis=0, dtype=np.float64)
        n = sums[:, -1]
        mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
        out = mean[:, :-1] if self._folded else mean[:, :-1] @ self.weight.T
        return out + self.bias, mean[:, -1], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and acceptance of each text."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        logits, known, n = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(1)
        score = np.where(n > 0, p[np.arange(len(p)), best], 0.0)
        accepted = (n > 0) & (score >= self.least_score) & (known >= self.least_known)
        return [self.langs[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())], score, accepted


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cuts(text: str) -> list[str]:
    """The whole text, and one cut of each length in ``CUTS`` from a place that the text's CRC-32 gives."""
    out, state = [text], zlib.crc32(text.encode("utf-8", "replace"))
    for size in CUTS:
        state = (state * 1664525 + 1013904223) % 2**32
        if len(text) > size:
            at = state % (len(text) - size)
            out.append(text[at : at + size])
    return out


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray, bool]], bits: int, dim: int = 16, epochs: int = 6, rate: float = 0.6, error: float = 0.005
) -> LanguageModel:
    """The model of (language, rows, counts, whether it calibrates) examples in a fixed order."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(11)
    model = LanguageModel(bits, langs, rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)), np.zeros(1 << bits, bool), np.zeros((len(langs), dim)), np.zeros(len(langs)))
    if not langs:
        return model
    number = {x: k for k, x in enumerate(langs)}
    train = [(number[y], c, n / n.sum()) for y, c, n, aside in rows if not aside and len(c)]
    aside = [(number[y], c, n / n.sum()) for y, c, n, a in rows if a and len(c)] or train
    share = np.bincount([y for y, _, _ in train], minlength=len(langs))
    # each language weighs the same, but a rare one does not take steps beyond three times the usual
    pull = np.minimum(3.0, len(train) / np.maximum(1, share) / len(langs))
    left = total = epochs * len(train)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            y, c, share_ = train[i]
            x = share_ @ model.embedding[c]
            z = model.weight @ x + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= rate * pull[y] * left / total
            back = p @ model.weight
            model.weight -= np.outer(p, x)
            model.bias -= p * 0.1
            # the mean divides by the text's length: steps of embeddings are given that back
            model.embedding[c] -= np.outer(np.minimum(1.0, share_ * len(c)), back)
            left -= 1
    for _, c, _ in train:
        model.met[c] = True
    _calibrate(model, aside, error)
    model.embedding, model.weight = model.embedding.astype(np.float32), model.weight.astype(np.float32)
    return model


def _calibrate(model: LanguageModel, aside: list[tuple[int, np.ndarray, np.ndarray]], error: float) -> None:
    """Temperature of least log loss over the examples left aside, and the two bounds of rejection."""
    if not aside:
        return
    y = np.array([a[0] for a in aside])
    z = np.array([share @ model.embedding[c] for _, c, share in aside]) @ model.weight.T + model.bias
    known = np.array([share @ model.met[c] for _, c, share in aside])
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean()
    model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss)
    p = _softmax(z / model.temperature)
    best, score = p.argmax(1), p.max(1)
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[order] != y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= error)
    model.least_score = float(score[order][fine[-1]]) if len(fine) else 1.0
    model.least_known = float(np.quantile(known, 0.001)) * 0.9


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 4 = 2, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 16, max_rows: int = 4_000, max_langs: int = 500, **how
) -> LanguageModel:
    """A model of at most ``max_rows`` texts (one a language at least) of rows that are not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''").select("lang", "text", F.xxhash64("text").alias("key"))
    # as many languages as the model holds, with the share of each one's different texts that is drawn
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("texts"))
    found = counted.orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not found:
        return fit([], bits, **how)
    each = max(1, max_rows // len(found))
    drawn = docs.sparkSession.createDataFrame([(r["lang"], min(_RANGE, int(_RANGE * 2 * each / max(1, r["texts"])) + 1)) for r in found], "lang string, below long")
    keys = rows.select("lang", "key").join(F.broadcast(drawn), "lang").filter(F.pmod("key", F.lit(_RANGE)) < F.col("below")).select("lang", "key").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(_RANGE)), "key"))
    keys = keys.withColumn("place", place).filter(F.col("place") <= each).select("lang", "key")
    sample = rows.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "key", "text")

    def run(batches):
        for batch in batches:
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                coded = [subword_counts(part, bits) for part in cuts(text)]
                packed = [[x.astype("<u4").tobytes() for x in pair] for pair in coded if len(pair[0])]
                if packed:
                    columns = [[lang] * len(packed), [key] * len(packed), [p[0] for p in packed], [p[1] for p in packed]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "key", "columns", "counts"])

    def learn(batches):
        # rows come in no fixed order; the descent depends on it
        got = sorted((key, lang, c, n) for b in batches for lang, key, c, n in zip(*(x.to_pylist() for x in b.columns)))
        examples = [(lang, np.frombuffer(c, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float64), key % 5 == 0) for key, lang, c, n in got]
        model = fit(examples, bits, **how)
        arrays = [pa.array([x.tobytes()], pa.binary()) for x in (model.embedding, model.met, model.weight, model.bias)]
        rest = [pa.array([model.langs], pa.list_(pa.string()))] + [pa.array([x], pa.float64()) for x in (model.temperature, model.least_score, model.least_known)]
        yield pa.RecordBatch.from_arrays(arrays + rest, names=["embedding", "met", "weight", "bias", "langs", "temperature", "least_score", "least_known"])

    examples = settle(sample.mapInArrow(run, "lang string, key long, columns binary, counts binary"))
    one = examples.coalesce(1).mapInArrow(learn, "embedding binary, met binary, weight binary, bias binary, langs array<string>, temperature double, least_score double, least_known double").first()
    langs = list(one["langs"])
    if not langs:
        return fit([], bits, **how)
    dim = len(one["embedding"]) // (4 << bits)
    shaped = lambda name, kind, *shape: np.frombuffer(one[name], kind).reshape(*shape)
    return LanguageModel(
        bits, langs, shaped("embedding", np.float32, 1 << bits, dim), shaped("met", bool, 1 << bits), shaped("weight", np.float32, len(langs), dim), shaped("bias", np.float64, len(langs)), one["temperature"], one["least_score"], one["least_known"]
    )


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lang, score, accepted = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])
        hashing.release()

    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")

"""Vector functions as columns, and the deterministic stand-in embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.normalize import normalize_for_lexical


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: str | Column) -> Column:
    """The vector at unit length as floats; an error for a zero or non-finite one."""
    size = norm(v)
    sound = (size > 0) & ~F.isnan(size) & (size != float("inf"))
    scaled = F.transform(v, lambda x: (x.cast("double") / size).cast("float"))
    return F.when(F.assert_true(sound, F.lit("a vector must be finite and not zero")).isNull(), scaled)


def is_unit(v: str | Column, within: float = 1e-3) -> Column:
    finite = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return finite & (F.abs(norm(v) - 1) < within)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def bag_of_words(text: str, dims: int = 16) -> list[float]:
    """Distinct normalized words counted in hashed buckets, at unit length; without words the first axis."""
    counts = np.zeros(dims)
    spaced = "".join(c if c.isalnum() else " " for c in normalize_for_lexical(text))
    for w in set(spaced.split()):
        counts[fnv1a(w.encode()) % dims] += 1
    if not counts.any():
        counts[0] = 1
    return (counts / np.linalg.norm(counts)).astype(np.float32).tolist()


def _fake_embedding(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(bag_of_words)


def fake_embedding(texts: str | Column) -> Column:
    return F.pandas_udf(_fake_embedding, "array<float>")(texts)



def unit_vectors(n: int, dims: int, seed: int = 1) -> np.ndarray:
    """``n`` random unit vectors from a 64-bit xorshift sequence."""
    state, out = seed & 0xFFFFFFFFFFFFFFFF or 1, np.empty(n * dims)
    for i in range(n * dims):
        state ^= state << 13 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 7
        state ^= state << 17 & 0xFFFFFFFFFFFFFFFF
        out[i] = (state >> 40) / 2**24 - 0.5
    v = out.reshape(n, dims)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


# --- random vectors, made in parallel ------------------------------------------------

#: Rows whose numbers are drawn side by side.
_SIDE_BY_SIDE = 4096


def _steps(state: np.ndarray) -> np.ndarray:
    """The next state of each sequence."""
    state = state ^ (state << np.uint64(13))
    state = state ^ (state >> np.uint64(7))
    return state ^ (state << np.uint64(17))


def _apply(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A step is linear over bits: of ``matrix``, what becomes of each single bit, those of the set bits are added."""
    out = np.zeros(len(states), np.uint64)
    for bit in range(64):
        out ^= np.where(states >> np.uint64(bit) & np.uint64(1), matrix[bit], np.uint64(0))
    return out


def _leap(steps: int) -> np.ndarray:
    """What ``steps`` steps make of each single bit, by squaring."""
    total, power = np.uint64(1) << np.arange(64, dtype=np.uint64), _steps(np.uint64(1) << np.arange(64, dtype=np.uint64))
    while steps:
        if steps & 1:
            total = _apply(power, total)
        power = _apply(power, power)
        steps >>= 1
    return total


def unit_rows(first: int, n: int, dims: int, seed: int = 1) -> np.ndarray:
    """Rows ``first`` to ``first + n`` of what ``unit_vectors`` draws, without those before them."""
    start = np.array([seed & 0xFFFFFFFFFFFFFFFF or 1], np.uint64)
    states, leap = _apply(_leap(first * dims), start), _leap(dims)
    while len(states) < n:
        states = np.concatenate((states, _apply(leap, states)))
        leap = _apply(leap, leap)
    states, out = states[:n], np.empty((n, dims))
    for k in range(dims):
        states = _steps(states)
        out[:, k] = (states >> np.uint64(40)).astype(np.float64) / 2**24 - 0.5
    size = np.linalg.norm(out, axis=1, keepdims=True)
    if not size.all():
        raise ValueError("a vector of zeros cannot be brought to unit length: take more dimensions or another seed")
    return (out / size).astype(np.float32)


def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 1, first: int = 0, id_col: str = "vec_id") -> DataFrame:
    """(id_col, embedding): ``n`` unit vectors from the ``first`` of the sequence on, each task drawing its own rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo in range(0, len(ids), _SIDE_BY_SIDE):
                part = ids[lo : lo + _SIDE_BY_SIDE]
                rows = unit_rows(int(part[0]), len(part), dims, seed)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dims, dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part - first), values], names=[id_col, "embedding"])

    # ids of a partition of a range follow each other
    return spark.range(first, first + n).mapInArrow(run, f"`{id_col}` long, embedding array<float>")

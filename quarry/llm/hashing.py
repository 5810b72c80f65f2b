"""Word and window hashes of whole batches of texts, in numpy.

Words are hashed as polynomials over their bytes, windows as polynomials over
their words' hashes (Rabin-Karp), both modulo 2**64: the hash of a run is a
difference of prefix sums, so a batch needs a few passes and no loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 1 << 21
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, _BLOCK), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    edge = np.empty(len(raw), bool)
    edge[0], edge[1:] = True, space[:-1]
    edge[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of bytes, in blocks of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + _BLOCK)))
        part = raw[low : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * _power("base", _BASE, len(part)), out=sums[1:])
        first = starts[i:j] - low
        inverse = _power("inverse", _BASE_INV, len(part))
        out[i:j] = mix((sums[ends[i:j] - low] - sums[first]) * inverse[first])
        i = j
    return out


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` words, by doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power = None, 0, words
    size = 1
    left = width
    while left:
        if left & 1:
            piece = power[done : done + n] if out is None else power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, size, 2**64)) + piece
            done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(pow(base, size, 2**64)) + power[size:]
            size *= 2
    return mix(out)


def release() -> None:
    """Gives the memory that Arrow holds on to back: a worker is kept between tasks, beside others."""
    pa.default_memory_pool().release_unused()


def owners(counts: np.ndarray) -> np.ndarray:
    """Which text each of the consecutive items belongs to."""
    return np.repeat(np.arange(len(counts)), counts)

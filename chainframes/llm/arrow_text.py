"""Whole Arrow columns of text as NumPy byte and word arrays, without a Python
object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a batch, and for each of the n texts
    plus one the number of words before it.  No word crosses a text's end."""
    n = len(raw)
    inside = ~_SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets, side="left")


_ODD = 0x9E3779B97F4A7C15


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over a random table of bytes,
    from running sums (all arithmetic modulo 2 ** 64), then mixed."""
    if not len(first):
        return np.zeros(0, np.uint64)
    table = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_ODD) + _U(seed))
    n = len(raw)
    base = (2 * seed + 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF | 1
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[raw] * powers(base, n), out=total[1:])
    value = (total[last] - total[first]) * powers(inverse, n)[first]
    return mix64(value + (last - first).astype(np.uint64) * _U(_ODD))


def run_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes (of one sequence)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = (2 * seed + 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF | 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out *= _U(base)
        out += words[i : i + m]
    return mix64(out)

"""Vectorised hashing of words and bytes for Python workers.

A text column is treated as one flat byte buffer with document offsets. Hashes
are polynomials modulo 2**64 over randomised symbols, so the hash of any range
follows from two prefix sums. All functions work on blocks of half a megabyte,
whatever the size of an Arrow batch; a text longer than a block is a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_SYMBOL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_RNG.integers(2**62, 2**63)) | 5
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` of about ``BLOCK`` bytes, each with its bytes and its offsets (rows + 1). Null is empty."""
    text = pc.fill_null(batch.column(column), "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the block, and per row the index of its first word (rows + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | edge[1:-1]
    end = end.copy()
    end[:-1] &= space[1:] | edge[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, at)


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**position; length + 1."""
    out = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * powers(len(symbols))[0], dtype=_U, out=out[1:])
    return out


def symbols(raw: np.ndarray) -> np.ndarray:
    """The random symbol of each byte."""
    return _SYMBOL[raw]


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    return prefix(symbols(raw))


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols in [start, end), the same wherever they stand; not yet mixed."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(range_hash(byte_prefix(raw), s, e) + (e - s).astype(_U))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def minimizers(key: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of k-mers that are the smallest of some window of ``window`` symbols within one row.

    key: hash of the k-mer that starts at each symbol (any value where it would leave its row).
    first: per row its first symbol (rows + 1). Of equally small k-mers all are taken, so the choice depends on the window's content alone.
    """
    n = len(key)
    if n < window:
        return np.zeros(0, np.int64)
    w = window - k + 1
    small = (key >> _U(33)).astype(np.uint32) + np.uint32(1)
    least = _sliding(small, w, np.minimum)[: n - window + 1].copy()
    row_end = np.repeat(first[1:], np.diff(first))
    least[np.arange(n - window + 1) + window > row_end[: n - window + 1]] = 0
    padded = np.zeros(n + w - 1, np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, w, np.maximum)[:n] == small)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def row_of(first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(first, positions, "right") - 1

"""Vectorised word access over Arrow string batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. UTF-8 continuation
and lead bytes are all above 0x7F, so the byte view and the character view of
`[^\\x20\\x09-\\x0D]+` give the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 2 << 20
LONG_SPAN = 256


def texts_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; one longer text stands alone."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words never cross from one text to the next."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = ~gap[edges]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = edges[edges > 0] - 1
    last[inner] = ~gap[inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Odd base of all polynomial sums; what tells seeds apart is what they sum.
BASE = 0x5851F42D4C957F2D
LOW_BITS = 11


@lru_cache(maxsize=2)
def _low_powers(base: int) -> np.ndarray:
    return _run(base, 1 << LOW_BITS)


def _run(base: int, n: int) -> np.ndarray:
    """base^i modulo 2^64, i < n."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def _high_powers(base: int, n: int) -> np.ndarray:
    return _run(pow(base, 1 << LOW_BITS, 1 << 64), (n >> LOW_BITS) + 1)


def powers(n: int) -> np.ndarray:
    """BASE^i modulo 2^64, i < n, put together from two short tables: nothing of the input's length is kept."""
    return (_high_powers(BASE, n)[:, None] * _low_powers(BASE)).ravel()[:n]


def inverse_powers(at: np.ndarray, n: int) -> np.ndarray:
    """BASE^-i modulo 2^64 for each i of `at`, all below n."""
    inverse = pow(BASE, -1, 1 << 64)
    return _high_powers(inverse, n)[at >> LOW_BITS] * _low_powers(inverse)[at & ((1 << LOW_BITS) - 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(2 * seed + 1) + U64(seed))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span: from one running polynomial sum, from BLAKE2 where the span is long.

    Sums modulo 2^64 have colliding spans of some hundred bytes for any base (Thue-Morse words).
    """
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(byte_table(seed)[raw] * powers(len(raw)), out=total[1:])
    out = mix((total[end] - total[start]) * inverse_powers(start, len(raw)) + (end - start).astype(U64) * U64(0xA24BAED4963EE407))
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(end - start >= LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=salt).digest(), "little")
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every `size` consecutive words of the sequence, document edges ignored."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words ^ U64(seed)) * powers(len(words)), out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse_powers(np.arange(n), len(words)))


def whole_windows(row: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows that lie in one text; row is the text of each word, ascending."""
    n = len(row) - size + 1
    return np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

"""Whole-text token results put together from distinct chunks.

A text is cut at places where no token of the vocabulary at hand can reach
across; its tokens are then its chunks' tokens in order. Each slice encodes its
distinct chunks once and gathers by code. A bounded memo keeps chunks between
batches; looking up a slice's chunks in it is one Arrow call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dossier.llm.words import SPACE

MEMO_CHUNKS = 150_000


def cut_points(pieces: Iterable[str]) -> np.ndarray:
    """By byte, the white space before which a text may be cut: that which follows no other character inside a piece."""
    out = SPACE.copy()
    for piece in pieces:
        raw = np.frombuffer(piece.encode(), np.uint8)
        joined = raw[1:][~SPACE[raw[:-1]] & SPACE[raw[1:]]]
        out[joined] = False
    return out


def chunk_spans(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of chunks that cover every byte: a run of white space with what follows, begun where `cuts` allows."""
    gap = SPACE[raw]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = gap & cuts[raw]
    first[1:] &= ~gap[:-1]
    first[edges] = True
    start = np.flatnonzero(first)
    return start, np.append(start[1:], len(raw))


def distinct_chunks(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Codes of the chunks and the distinct chunks themselves."""
    sizes = end - start
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    if int(sizes.sum()) != len(raw):
        keep = np.zeros(len(raw) + 1, np.int8)
        keep[start] += 1
        keep[end] -= 1
        raw = raw[np.cumsum(keep[:-1], dtype=np.int8) > 0]
    data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = data.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts flat[offsets[c]:offsets[c + 1]] of all codes in order, and where each ends."""
    n = np.diff(offsets)[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(offsets[codes] - (ends - n), n) + np.arange(total)
    return flat[at], ends


class ChunkEncoder:
    """Ids of chunks, one part of a flat array each; `encode` is asked for lists of distinct misses only."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], memo: int = MEMO_CHUNKS):
        self.encode, self.memo = encode, memo
        self.known, self.flat, self.offsets = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) with a part for each chunk, in their order."""
        where = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(where < 0)
        flat, offsets = self.flat, self.offsets
        where = where.astype(np.int64)
        if len(missing):
            new = chunks.take(pa.array(missing))
            ids, edges = self.encode(new.to_pylist())
            where[missing] = len(self.known) + np.arange(len(missing))
            flat, offsets = np.concatenate([flat, ids]), np.concatenate([offsets, offsets[-1] + edges[1:]])
            room = min(len(missing), self.memo - len(self.known))
            if room > 0:
                self.known = pa.concat_arrays([self.known, new.slice(0, room)])
                self.offsets = offsets[: len(self.known) + 1].copy()
                self.flat = flat[: self.offsets[-1]].copy()
        out, ends = gather(flat, offsets, where)
        return out, np.append(0, ends)


def flattened(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of lists of ids."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
    flat = np.fromiter((i for p in parts for i in p), np.uint32, int(offsets[-1]))
    return flat, offsets

"""Linear scoring of hashed word and character n-grams, and its training in numpy.

A text's margin is bias + mean weight of its byte trigrams + mean weight of its
words, so scoring is two gathers and two segment sums an Arrow slice. Training
reads a bounded sample of rows as sparse (bucket, value) lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.words import SLICE_BYTES, slices, span_hashes, spans, texts_of

BUCKETS = 1 << 16
GAIN = 30.0


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets with their (first, past) of each text, word buckets (in the upper half) with their edges."""
    grams = trigram_buckets(raw) if len(raw) > 2 else np.zeros(0, np.uint32)
    first = np.minimum(offsets[:-1], len(grams))
    past = np.maximum(first, np.minimum(offsets[1:] - 2, len(grams)))
    start, end, _ = spans(raw, offsets)
    words = (span_hashes(raw, start, end, seed=9) >> np.uint64(48)).astype(np.uint32) + np.uint32(BUCKETS)
    return grams, first, past, words, np.searchsorted(start, offsets)


@dataclass
class HashedLinear:
    """Weights of both halves, bias, and the calibration p = sigmoid(slope * margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams, first, past, words, edges = _segments(raw, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        for buckets, lo, hi in ((grams, first, past), (words, edges[:-1], edges[1:])):
            total = np.zeros(len(buckets) + 1)
            np.cumsum(self.weights[buckets], out=total[1:], dtype=np.float64)
            out += GAIN * (total[hi] - total[lo]) / np.maximum(1, hi - lo)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.shift)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _sparse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, target, text) to (key, target, buckets, values)."""
    for batch in batches:
        raw_all, at = texts_of(batch.column(2))
        buckets, values = [], []
        for lo, hi in slices(at, SLICE_BYTES):
            grams, first, past, words, edges = _segments(raw_all[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            for i in range(hi - lo):
                g, gn = np.unique(grams[first[i] : past[i]], return_counts=True)
                w, wn = np.unique(words[edges[i] : edges[i + 1]], return_counts=True)
                buckets.append(np.concatenate([g, w]).astype(np.int32))
                values.append(np.concatenate([gn * (GAIN / max(1, gn.sum())), wn * (GAIN / max(1, wn.sum()))]).astype(np.float32))
        lists = [pa.array(x, pa.list_(t)) for x, t in ((buckets, pa.int32()), (values, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "target", "buckets", "values"])


def sparse_sample(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Targets, buckets and values of a bounded sample of rows (key, target, text), one a key, in order of the key."""
    table = rows.mapInArrow(_sparse_batches, "key long, target double, buckets array<int>, values array<float>").orderBy("key").toArrow()
    lists = {}
    for c in ("buckets", "values"):
        column = table[c].combine_chunks()
        flat, edges = column.values.to_numpy().copy(), column.offsets.to_numpy()
        lists[c] = np.split(flat[: edges[-1]], edges[1:-1]) if len(column) else []
    targets = table["target"].to_numpy().copy()
    del table, column
    pa.default_memory_pool().release_unused()  # the driver keeps the arrays, not the transfer
    return targets, lists["buckets"], lists["values"]


def one_text_a_key(docs: DataFrame, chosen: DataFrame, keep: str = "target") -> DataFrame:
    """(key, `keep`, text) of the chosen keys: one row each, the smallest, however many rows share a key."""
    rows = docs.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.struct(keep, "text")).alias("row"))
    return rows.select("key", f"row.{keep}", "row.text")


def hash_sample(keys: DataFrame, most: int) -> DataFrame:
    """`most` rows at most, those with the smallest keyed hash of `key`: the same rows at any partitioning."""
    return keys.orderBy(F.xxhash64(F.lit(77), "key"), "key").limit(most)


def train(targets: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray], epochs: int = 6, rate: float = 0.005, decay: float = 1e-6, seed: int = 5) -> HashedLinear | None:
    """Logistic regression by AdaGrad on four fifths, Platt calibration on the rest; None without two classes."""
    if len(targets) < 10 or not (targets > 0.5).any() or not (targets <= 0.5).any():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(targets))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    w, past, b, b_past = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-3), 0.0, 1e-3
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, v = buckets[i], values[i]
            g = float(sigmoid(b + w[at] @ v)) - targets[i]
            step = g * v + decay * w[at]
            past[at] += step * step
            w[at] -= rate * step / np.sqrt(past[at])
            b_past += g * g
            b -= rate * g / np.sqrt(b_past)
    margins = np.array([b + w[buckets[i]] @ values[i] for i in held])
    slope, shift = platt(margins, targets[held])
    return HashedLinear(w, b, slope, shift)


def platt(margins: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Newton steps on the two-parameter logistic fit, with Platt's smoothed targets."""
    n1 = float(targets.sum())
    n0 = len(targets) - n1
    y = targets * (n1 + 1) / (n1 + 2) + (1 - targets) / (n0 + 2)
    scale = float(np.abs(margins).max(initial=0)) or 1.0
    margins = margins / scale
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(slope * margins + shift)
        d, h = p - y, p * (1 - p)
        grad = np.array([d @ margins + 1e-3 * (slope - 1), d.sum()])
        hess = np.array([[h @ (margins * margins) + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-9:
            break
    return (float(slope) / scale, float(shift)) if slope > 0 else (1.0, 0.0)

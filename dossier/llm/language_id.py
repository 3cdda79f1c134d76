"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte 2-, 3- and 4-grams inside words with their boundary marks
(ASCII letters lower-cased), hashed to buckets with a small vector each. A
text's vector is their mean; a linear softmax names the language. Embeddings
and softmax are trained by stochastic gradient descent in numpy on at most
TRAIN_ROWS labelled rows (a keyed hash chooses); a held-back fifth fixes the
temperature and the rejection threshold. Since everything is linear, scoring
gathers each bucket's class scores (embedding times softmax weights).

Defined results: a null text or one without a letter is `und` with score 0.
`accepted` is false where the calibrated score is below the threshold; the
prediction itself is kept. A text is scored by the subwords it has, however few;
a single byte has none and gets the answer of the bias. Of equally likely
languages the alphabetically first is named. With no labelled rows everything is
`und`. A row without doc_id is predicted, is not held out and is never learned
from; of rows that share one the alphabetically first language and text are
learned from. Texts of any length are read whole. Repeated rows give one row
each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents
from dossier.llm.hashed_linear import hash_sample, one_text_a_key
from dossier.llm.words import SPACE, slices, texts_of

TRAIN_ROWS = 3000
BUCKETS = 1 << 16
DIMENSIONS = 16
FOLDS = 5
ACCEPTED_PRECISION = 0.99
#: A text of few subwords moves each of them far: its step is this much smaller by the square sum of its shares.
SHORT_DAMPING = 16.0
UNDETERMINED = "und"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SPACE] = 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def subword_buckets(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, whether a subword of n bytes may start here, its bucket) for n = 2, 3, 4 and every byte; the last ones reach into blanks."""
    size = len(raw)
    x = np.full(size + 3, 32, np.uint32)
    x[:size] = FOLD[raw]
    gap = x == 32
    code = x[:size] * np.uint32(0x9E3779B1) ^ x[1 : size + 1] * np.uint32(0x85EBCA6B)
    ok = ~(gap[:size] & gap[1 : size + 1])
    for n, factor in ((2, 0), (3, 0xC2B2AE35), (4, 0x165667B1)):
        if n > 2:
            code = (code * np.uint32(0x27D4EB2F)) ^ (x[n - 1 : size + n - 1] * np.uint32(factor))
            ok = ok & ~gap[n - 2 : size + n - 2]  # no gap but at the edges
        yield n, ok, ((code * np.uint32(0x27D4EB2F)) ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1) >> np.uint32(16)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(ASCII_LETTER[raw], out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, width = len(offsets) - 1, len(self.languages)
        sums, n = np.zeros((rows, width)), np.zeros(rows)
        for size, ok, bucket in subword_buckets(raw):
            at = np.flatnonzero(ok)
            lo = np.searchsorted(at, offsets[:-1])
            hi = np.maximum(lo, np.searchsorted(at, offsets[1:] - size + 1))  # those that end within their text
            n += hi - lo
            picked = self.scores[bucket[at]]
            for c in range(width):
                total = np.zeros(len(at) + 1)
                np.cumsum(picked[:, c], out=total[1:], dtype=np.float64)
                sums[:, c] += total[hi] - total[lo]
        return sums / np.maximum(1, n)[:, None] + self.bias

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(raw, offsets) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = [(ok[: max(0, len(raw) - size + 1)], b) for size, ok, b in subword_buckets(raw)]
    found, n = np.unique(np.concatenate([b[: len(ok)][ok] for ok, b in whole]), return_counts=True)
    return found, n / max(1, n.sum())


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [bag(x.as_py() or "") for x in batch.column(2)]
        lists = [pa.array([b[k].astype(t) for b in bags], pa.list_(a)) for k, t, a in ((0, np.int32, pa.int32()), (1, np.float32, pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "lang", "buckets", "shares"])


def fit(langs: list[str], buckets: list[np.ndarray], shares: list[np.ndarray], epochs: int = 5, rate: float = 4.0, seed: int = 3) -> LanguageModel | None:
    rng, languages = np.random.default_rng(seed), sorted(set(langs))
    use = [i for i in range(len(langs)) if len(buckets[i])]
    if not use:
        return None
    y = np.array([languages.index(x) for x in langs])
    order = rng.permutation(use)
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 25 else (order, order)
    vectors = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    soft, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, share = buckets[i], shares[i]
            eta = rate * (1 - done / steps) / (1 + SHORT_DAMPING * float(share @ share))
            done += 1
            hidden = share @ vectors[at]
            g = softmax(hidden @ soft + bias)
            g[y[i]] -= 1
            back = soft @ g
            soft -= eta * np.outer(hidden, g)
            bias -= 0.01 * eta * g
            vectors[at] -= eta * np.outer(share, back) * 8
    scores = (vectors @ soft).astype(np.float32)
    raw = np.array([shares[i] @ scores[buckets[i]] + bias for i in held])
    true = y[held]
    grid = np.geomspace(0.02, 20, 200)
    loss = [-np.log(softmax(raw / t)[np.arange(len(held)), true] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(raw / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == true
    cut = np.argsort(-top)
    precise = np.cumsum(right[cut]) / np.arange(1, len(cut) + 1) >= ACCEPTED_PRECISION
    threshold = float(top[cut][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return LanguageModel(languages, scores, bias, temperature, threshold)


def train_language_model(labelled: DataFrame, most: int = TRAIN_ROWS) -> LanguageModel | None:
    """From rows (key, lang, text); lang is never null."""
    chosen = hash_sample(labelled.select("key").filter("key is not null").distinct(), most)
    table = one_text_a_key(labelled, chosen, "lang").mapInArrow(_bag_batches, "key long, lang string, buckets array<int>, shares array<float>").orderBy("key").toArrow()
    lists = {c: [x.values.to_numpy() for x in table[c].combine_chunks()] for c in ("buckets", "shares")}
    return fit(table["lang"].to_pylist(), lists["buckets"], lists["shares"])


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw_all, at = texts_of(batch.column(2))
            named, scores, accepted = [], [], []
            for lo, hi in slices(at):
                raw, offsets = raw_all[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                known = has_letter(raw, offsets) if model else np.zeros(hi - lo, bool)
                best, p = model.predict(raw, offsets) if model else (np.zeros(hi - lo, int), np.zeros(hi - lo))
                named += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                scores.append(np.where(known, p, 0.0))
                accepted.append(known & (p >= (model.threshold if model else 1)))
            columns = [pa.array(named, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(accepted) if accepted else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify_languages(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row; fold 0 of doc_id is never learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text", "lang")
    labelled = rows.filter("not held_out and lang is not null and text is not null").select(F.col("doc_id").alias("key"), "lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train_language_model(labelled, most))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict_batches(shared), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))

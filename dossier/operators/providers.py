"""Model calls behind Arrow batches, with deterministic offline stand-ins.

A provider is any picklable object with the one method named in its protocol.
Every operator calls it on distinct inputs only and joins the answers back;
rows that a provider leaves out keep null answers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK_INPUT = "N/A"
BATCH_ITEMS, BATCH_CHARS = 256, 60_000
ATTEMPTS = 3


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PairScorer(Protocol):
    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class Judge(Protocol):
    def judge(self, payloads: Sequence[str]) -> Sequence[str | None]: ...


class HashEmbedder:
    """Signed token hashing into a unit vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for token in re.findall(r"[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


class OverlapScorer:
    """Share of the first text's tokens that the second has."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        tokens = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))
        return [len(tokens(a) & tokens(b)) / max(1, len(tokens(a))) for a, b in pairs]


class KeywordJudge:
    """`yes` where a payload holds any of the words."""

    def __init__(self, words: Sequence[str]):
        self.words = [w.lower() for w in words]

    def judge(self, payloads: Sequence[str]) -> list[str]:
        return ["yes" if any(w in p.lower() for w in self.words) else "no" for p in payloads]


def bounded_batches(texts: Sequence[str], items: int = BATCH_ITEMS, chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(lo, hi) of runs within both bounds; a longer text stands alone."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if i > lo and (i - lo >= items or size + len(text) > chars):
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def call_halving(call, inputs: Sequence, attempts: int = ATTEMPTS) -> list:
    """Answers in order; a failing batch is halved, a failing item tried `attempts` times in all, then raised."""
    for left in range(attempts, 0, -1):
        try:
            out = list(call(inputs))
            if len(out) != len(inputs):
                raise ValueError(f"{len(out)} answers to {len(inputs)} inputs")
            return out
        except Exception:
            if len(inputs) > 1:
                half = len(inputs) // 2
                return call_halving(call, inputs[:half], attempts) + call_halving(call, inputs[half:], attempts)
            if left == 1:
                raise
    return []


def _mapped(call, kind: pa.DataType, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.strip() or BLANK_INPUT for x in batch.column(1).fill_null("").to_pylist()]
            answers = [a for lo, hi in bounded_batches(texts) for a in call_halving(call, texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, kind)], list(names))

    return run


def digest(text: str):
    return F.sha2(F.coalesce(F.trim(F.col(text)), F.lit("")), 256)


def embed_texts(rows: DataFrame, text: str, provider: Embedder, cache: str | None = None) -> DataFrame:
    """rows with `vector`. Distinct texts are embedded once; with a cache folder only those it lacks, which it then holds."""
    keyed = rows.withColumn("_key", digest(text))
    wanted = keyed.groupBy("_key").agg(F.min(F.col(text)).alias("_text"))
    schema = "_key string, vector array<double>"
    if cache is None:
        vectors = wanted.mapInArrow(_mapped(provider.embed, pa.list_(pa.float64()), ("_key", "vector")), schema)
    else:
        held = _cached(rows.sparkSession, cache, schema)
        new = wanted.join(held.select("_key"), "_key", "left_anti")
        new.mapInArrow(_mapped(provider.embed, pa.list_(pa.float64()), ("_key", "vector")), schema).write.mode("append").parquet(cache)
        vectors = _cached(rows.sparkSession, cache, schema).dropDuplicates(["_key"])
    return keyed.join(vectors, "_key", "left").drop("_key")


def _cached(spark, cache: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(cache)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def judge_rows(rows: DataFrame, payload: str, provider: Judge, name: str = "answer") -> DataFrame:
    """rows with the provider's answer to each distinct payload."""
    keyed = rows.withColumn("_key", digest(payload))
    wanted = keyed.groupBy("_key").agg(F.min(F.col(payload)).alias("_text"))
    answers = wanted.mapInArrow(_mapped(provider.judge, pa.string(), ("_key", name)), f"_key string, {name} string")
    return keyed.join(answers, "_key", "left").drop("_key")


def retry_failed(rows: DataFrame, failed: str, payload: str, provider: Judge, name: str = "answer") -> DataFrame:
    """Rows marked as failed are judged again; the others stay as they are."""
    bad = F.coalesce(F.trim(F.col(failed)), F.lit("")) != ""
    again = judge_rows(rows.filter(bad).drop(name), payload, provider, name).withColumn(failed, F.lit(""))
    return rows.filter(~bad).unionByName(again)


def score_pairs(rows: DataFrame, query: str, text: str, provider: PairScorer, name: str = "pair_score") -> DataFrame:
    """rows with a pair score; equal pairs are scored once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in (query, text)]
            pairs = list(zip(*[batch.column(i).fill_null("").to_pylist() for i in at], strict=True))
            distinct = list(dict.fromkeys(pairs))
            found = dict(zip(distinct, call_halving(provider.score, distinct), strict=True)) if distinct else {}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(found[p]) for p in pairs], pa.float64())], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def closed_selection(selected: DataFrame, candidates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(selections that name a candidate, those that don't)."""
    known = candidates.select(*keys).distinct()
    return selected.join(known, keys, "left_semi"), selected.join(known, keys, "left_anti")


def concept_similarity(rows: DataFrame, a: str, b: str, provider: Embedder, name: str = "concept_similarity") -> DataFrame:
    """Cosine of two phrases; each distinct phrase is embedded once, a blank one gives null."""
    phrases = rows.select(F.col(a).alias("_p")).union(rows.select(F.col(b).alias("_p"))).filter("trim(_p) <> ''").distinct()
    vectors = embed_texts(phrases, "_p", provider)
    left, right = (vectors.select(F.col("_p").alias(c), F.col("vector").alias(f"_{i}")) for i, c in enumerate((a, b)))
    both = rows.join(left, a, "left").join(right, b, "left")
    return both.withColumn(name, cosine("_0", "_1")).drop("_0", "_1")


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)

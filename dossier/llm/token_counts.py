"""Token counts behind a digest cache.

A text is normalised to its UTF-8 bytes (null: empty) and digested; the cache
table holds (content digest, tokenizer digest, token count). The input's
digests are joined with the cache; only distinct misses are encoded, appended,
and joined back. The tokenizer digest is that of its file, so a new version
never meets old counts. Texts leave the map side only where a filter takes them
for a miss (at most 0.6 % too many, up to 16 million misses): with a warm cache
none does.

Defined results: null and empty texts count 0 tokens. Repeated rows give one
row each, rows without doc_id too. Texts of any length are encoded whole.
Special strings inside texts are encoded as the library does by default. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents, removed, settled, shared_dir
from dossier.llm.key_filter import key_set
from dossier.llm.pieces import ChunkEncoder, chunk_spans, distinct_chunks
from dossier.llm.words import slices, texts_of

TOKEN_LIMIT = 512
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: White space beyond the ASCII set: texts with it are encoded whole, since a chunk could part such a run.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SLICE = 8 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=2)
def _counter(path: str) -> ChunkEncoder:
    tokenizer = load_tokenizer(path)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return np.array([len(e) for e in done], np.uint32), np.arange(len(done) + 1)

    return ChunkEncoder(encode)


def count_slice(raw: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of the slice; byte-level vocabularies part words before white space, whatever stands there."""
    start, end = chunk_spans(raw, offsets)
    codes, chunks = distinct_chunks(raw, start, end)
    sizes, _ = _counter(path)(chunks)
    total = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes[codes], out=total[1:])
    out = np.diff(total[np.searchsorted(start, offsets)])
    blob = raw.tobytes()
    if OTHER_SPACE.search(blob):
        for i in range(len(offsets) - 1):
            text = blob[offsets[i] : offsets[i + 1]]
            if OTHER_SPACE.search(text):
                out[i] = len(load_tokenizer(path).encode(text.decode(), add_special_tokens=False))
    return out


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            counts = [count_slice(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], path) for lo, hi in slices(offsets, SLICE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["content", "n_tokens"])

    return run


def _among(missing):
    """Arrow mapper: the rows whose key, in the last column, the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(missing.value.holds(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:  # no such folder yet
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); appends what was missing to the cache folder."""
    spark, version, text = docs.sparkSession, file_digest(tokenizer), F.coalesce(F.col("text"), F.lit(""))
    content = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    keyed = settled(docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    # one text of each digest that the cache lacks, known by its smallest doc_id and the digest, as a doc_id can have several texts
    distinct = keyed.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    misses = settled(distinct.join(stored.select("content"), "content", "left_anti"))
    # only rows that a filter of these takes for one of them leave the map side; the joins below are exact
    named = F.xxhash64("doc_id", "content").alias("key")
    missing = spark.sparkContext.broadcast(key_set(misses.select(named)))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text"), content.alias("content")).select("*", named)
    texts = texts.mapInArrow(_among(missing), texts.schema).drop("key")
    # rows that repeat both are combined before the exchange
    single = texts.filter("doc_id is not null").groupBy("doc_id", "content").agg(F.first("text").alias("text"))
    wanted = single.join(misses.filter("doc_id is not null"), ["doc_id", "content"]).select("content", "text")
    # a digest that only rows without doc_id have is found by its content
    unnamed = texts.filter("doc_id is null").groupBy("content").agg(F.first("text").alias("text"))
    nameless = unnamed.join(misses.filter("doc_id is null").select("content"), "content", "left_semi")
    counted = wanted.unionByName(nameless.select("content", "text")).mapInArrow(_count_batches(tokenizer), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # texts of one digest are equal, so repeated cache rows (two writers at once) agree
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(settled(counts), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own for each call: what it costs is the cost of a cold cache."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    out = token_counts(documents(spark, sf_dir), cache, tokenizer_path("byte_bpe_50k.json"))
    removed(spark, cache)  # the result rests on checkpoints
    return out

"""Quality rules: fixed base rules, then a hashed n-gram classifier against a fixed threshold.

The classifier is logistic regression on hashed words and byte trigrams, fitted
on at most TRAIN_ROWS labelled rows (a keyed hash chooses), calibrated on a
fifth of them, broadcast, and applied in Arrow batches to whole texts.

Defined results: a null or blank text has no words and fails the base rules.
Without labels of both classes every text that passes the base rules is kept
and its probability is 1. A probability of the threshold exactly is kept. Rows
without doc_id are judged, never learned from; of clashing labels of one doc_id
the greatest counts, of its texts the smallest is learned from. Texts of any
length are judged whole. Repeated rows give one row each; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents
from dossier.llm.hashed_linear import HashedLinear, hash_sample, one_text_a_key, sparse_sample, train
from dossier.llm.text_stats import text_stats
from dossier.llm.words import slices, texts_of

TRAIN_ROWS = 4000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
KEEP_AT = 0.3
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, quality_p double"


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> HashedLinear | None:
    """The classifier of quality 1 against 0, from at most `most` labelled rows."""
    labelled = labels.filter("quality in (0, 1) and doc_id is not null")
    labelled = labelled.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("quality").cast("double").alias("target"))
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return train(*sparse_sample(one_text_a_key(texts, hash_sample(labelled, most))))


def _judge(model: HashedLinear | None, column: pa.Array, keep_at: float) -> dict[str, np.ndarray]:
    """Counts, verdict and probability of each text of an Arrow column."""
    raw_all, at = texts_of(column)
    parts = {c: [] for c in [*STATS, "quality_p"]}
    for lo, hi in slices(at):
        raw, offsets = raw_all[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        stats = text_stats(raw, offsets)
        for c in STATS:
            parts[c].append(stats[c])
        parts["quality_p"].append(model.probabilities(model.margins(raw, offsets)) if model else np.ones(hi - lo))
    out = {c: np.concatenate(x) if x else np.zeros(0) for c, x in parts.items()}
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["quality_p"] >= keep_at)
    return out


def _rule_batches(shared, keep_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judge(shared.value, batch.column(1), keep_at)
            columns = [*(pa.array(found[c], pa.int64()) for c in STATS), *(pa.array(found[c], pa.bool_()) for c in ("base_failed", "kept")), pa.array(found["quality_p"], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *STATS, "base_failed", "kept", "quality_p"])

    return run


def _kept_batches(shared, keep_at: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(shared.value, batch.column(text_at), keep_at)["kept"], pa.bool_()))

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, n_words, counts, base_failed, kept, quality_p) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rule_batches(shared, keep_at), SCHEMA)


def only_quality(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps; judged and passed on in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    return docs.mapInArrow(_kept_batches(shared, keep_at, docs.columns.index("text")), docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

"""Quality classifier from a weak-label model.

Ten heuristic labellers vote good (1), bad (-1) or abstain (0) on each whole
text. Counts of vote patterns over all rows (3^10 patterns at most) are all that
expectation-maximisation needs: it estimates the class balance and each
labeller's vote distribution for either class, hence a posterior for each
pattern. Posterior labels of at most TRAIN_ROWS texts (a keyed hash of doc_id
and text chooses) train a hashed n-gram scorer, which then scores every text. A
sampled text carries the label of its own votes, whatever other texts its doc_id
has.

Defined results: null and blank texts get the votes of an empty text. Where one
class never shows in the sample, the score is the posterior itself. A score of
KEEP_AT exactly is kept. Rows without doc_id count, are sampled and scored as
any other. Texts of any length are read whole. Repeated rows give one row each
and count as one in the sample; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents, settled
from dossier.llm.hashed_linear import hash_sample, one_text_a_key, sparse_sample, train
from dossier.llm.text_stats import text_stats
from dossier.llm.words import slices, texts_of

TRAIN_ROWS = 4000
KEEP_AT = 0.5
#: (name, quantity, good test, bad test) of each labeller; quantities are below.
LABELLERS = [
    ("length", "words", lambda x: x >= 80, lambda x: x < 20),
    ("symbols", "symbols_a_word", lambda x: x <= 0.01, lambda x: x > 0.1),
    ("capitals", "upper_share", lambda x: x <= 0.15, lambda x: x > 0.4),
    ("repeated_lines", "dup_line_share", lambda x: x <= 0.05, lambda x: x > 0.3),
    ("repeated_words", "repeat_share", lambda x: x <= 0.1, lambda x: x > 0.3),
    ("shouting", "shouts_a_word", lambda x: x <= 0.02, lambda x: x > 0.2),
    ("tables", "bars_a_word", lambda x: x <= 0.01, lambda x: x > 0.2),
    ("echoes", "echo_share", lambda x: x <= 0.02, lambda x: x > 0.2),
    ("marked_words", "marked_share", lambda x: x <= 0.02, lambda x: x > 0.2),
    ("sentence_ends", "ended_share", lambda x: x >= 0.5, lambda x: x < 0.05),
]


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """rows x labellers of -1, 0, 1."""
    words, lines = np.maximum(1, stats["n_words"]), np.maximum(1, stats["n_lines"])
    quantity = {
        "words": stats["n_words"], "symbols_a_word": stats["n_symbols"] / words, "upper_share": stats["n_upper"] / np.maximum(1, stats["n_letters"]),
        "dup_line_share": stats["n_dup_lines"] / lines, "repeat_share": stats["n_repeat_words"] / words, "shouts_a_word": stats["n_shouts"] / words,
        "bars_a_word": stats["n_bars"] / words, "echo_share": stats["n_echoes"] / words, "marked_share": stats["n_marked_words"] / words, "ended_share": stats["n_ended_lines"] / lines,
    }
    return np.stack([good(quantity[q]).astype(np.int8) - bad(quantity[q]).astype(np.int8) for _, q, good, bad in LABELLERS], axis=1)


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = texts_of(batch.column(1))
        found = [votes(text_stats(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) for lo, hi in slices(at)]
        signs = np.concatenate(found) if found else np.zeros((0, len(LABELLERS)), np.int8)
        patterns = pa.array(["".join("-0+"[v + 1] for v in row) for row in signs], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), patterns], ["key", "votes"])


def label_model(patterns: list[str], counts: list[int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy of each labeller when it votes); an abstention is no evidence."""
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns], np.int8).reshape(len(patterns), len(LABELLERS))
    n = np.array(counts, float)
    post = np.clip(0.5 + v.sum(axis=1) / (2 * len(LABELLERS)), 0.05, 0.95)  # majority to begin with
    share = np.zeros((2, 3, len(LABELLERS)))
    for _ in range(rounds):
        balance = (n @ post + 1) / (n.sum() + 2)
        for c, weight in ((0, n * (1 - post)), (1, n * post)):
            for k in range(3):
                share[c, k] = weight @ (v == k - 1) + 1
            share[c] /= share[c].sum(axis=0)
        logit = np.log(balance / (1 - balance)) + sum(np.where(v == k - 1, np.log(share[1, k] / share[0, k]), 0).sum(axis=1) for k in (0, 2))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    right = balance * share[1, 2] + (1 - balance) * share[0, 0]
    wrong = balance * share[1, 0] + (1 - balance) * share[0, 2]
    return post, right / (right + wrong)


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, posterior = shared.value
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            pattern, post, score = [], [], []
            for lo, hi in slices(at):
                part, edges = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                names = ["".join("-0+"[x + 1] for x in row) for row in votes(text_stats(part, edges))]
                pattern += names
                post.append(np.array([posterior[x] for x in names]))
                score.append(model.probabilities(model.margins(part, edges)) if model else post[-1])
            post, score = (np.concatenate(x) if x else np.zeros(0) for x in (post, score))
            columns = [pa.array(pattern, pa.string()), pa.array(post), pa.array(score), pa.array(score >= KEEP_AT, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "votes", "posterior", "score", "kept"])

    return run


def weak_quality(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    voted = settled(keyed.mapInArrow(_vote_batches, "key long, votes string"))
    seen = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # 3^10 rows at most
    post, _ = label_model([r["votes"] for r in seen], [r["n"] for r in seen])
    posterior = dict(zip([r["votes"] for r in seen], map(float, post), strict=True))
    known = docs.sparkSession.createDataFrame([*posterior.items()], "votes string, target double")
    keys = voted.groupBy("key").agg(F.max("votes").alias("votes"))  # a key's texts are one text
    chosen = hash_sample(keys, most).join(F.broadcast(known), "votes").select("key", "target")
    sample = one_text_a_key(keyed, chosen)
    shared = docs.sparkSession.sparkContext.broadcast((train(*sparse_sample(sample)), posterior))
    return rows.mapInArrow(_score_batches(shared), "doc_id long, votes string, posterior double, score double, kept boolean")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(documents(spark, sf_dir))

"""Corpus preparation: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next stage's docs. All but
the last return the columns of documents, whatever further columns there are and
however they are named. An empty table stays empty through every stage; texts of
any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.exact_dedup import without_copies
from dossier.llm.frames import documents, removed, shared_dir
from dossier.llm.jaccard_join import without_near_copies
from dossier.llm.packing import best_fit_packing
from dossier.llm.quality_rules import only_quality
from dossier.llm.substring_dedup import without_repeats
from dossier.llm.token_counts import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier trained on this corpus's labels.

    Null, blank and short texts fail the base rules and go. Each row is judged by
    itself, so rows that repeat go or stay together. Without labels of both
    classes the base rules alone decide.
    """
    return only_quality(docs, documents(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    The longest text as written stays, then the smallest doc_id (null last), then
    the first row. Null and blank texts are one group.
    """
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest doc_id.

    Rows without doc_id and rows without words link with nothing and stay; rows
    of one doc_id go or stay together.
    """
    return without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller doc_id has (null counts as the largest).

    Other white space stays as it is; n_chars follows the text. A row that loses
    all its words goes; null, blank and short texts stay unchanged. Rows of one
    doc_id take nothing from each other.
    """
    return without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts with their sequence and place; null and empty texts are one separator, repeated rows are packed each."""
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage before it is written in the shared folder, and removed once the next is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training, components and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None

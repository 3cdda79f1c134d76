"""A whole match run: requirements and a catalogue in, wide rows and JSON records out; and a run's candidates ranked anew.

Every requirement that is a candidate is looked up by words and by vector; the
two lists are fused, the best of them scored in pairs, and the first ones kept.
Skipped requirements keep their row, without matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import text_or_blank
from dossier.functions.text import is_yes
from dossier.operators.providers import PairScorer, score_pairs
from dossier.operators.retrieval import bm25_top_k, fuse_channels, rerank, vector_top_k
from dossier.sources.scratch import settled

RETRIEVED, SHOWN = 100, 20
CANDIDATE = ("doc_id", "display", "keyword_rank", "keyword_score", "semantic_rank", "semantic_score", "rrf", "retrieval_rank")


def candidates_of(requirements: DataFrame, catalog: DataFrame, retrieved: int = RETRIEVED) -> DataFrame:
    """(key, CANDIDATE columns, doc_text): the fused `retrieved` best of each requirement that is a candidate.

    requirements: key (a number), query, vector, is_candidate; catalog: doc_id,
    text, vector, display. Rows without a vector are found by words only.
    """
    asked = requirements.filter(is_yes("is_candidate")).select("key", text_or_blank("query").alias("query"), "vector")
    keyword = bm25_top_k(catalog, asked, retrieved, "doc_id", "text", "key", "query")
    named = lambda df, name: df.select(F.col(name).alias("id"), "vector")
    semantic = vector_top_k(named(catalog, "doc_id"), named(asked, "key"), retrieved, "id", "vector")
    fused = fuse_channels(settled(keyword), settled(semantic), retrieved)
    return fused.join(catalog.select("doc_id", text_or_blank("text").alias("doc_text"), text_or_blank("display").alias("display")), "doc_id").withColumnRenamed("query_id", "key")


def ranked_anew(candidates: DataFrame, queries: DataFrame, scorer: PairScorer, shown: int = SHOWN) -> DataFrame:
    """candidates with pair_score and final_rank, the first `shown` of each key; queries: key, query."""
    pairs = candidates.join(queries.select("key", text_or_blank("query").alias("query")), "key")
    scored = score_pairs(pairs, "query", "doc_text", scorer).withColumn("pair_score", F.round("pair_score", 6))
    return rerank(scored, "pair_score", shown, by="key").drop("query")


def run_records(requirements: DataFrame, candidates: DataFrame, best: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row a requirement: its own columns, what was found by either channel, Matched_Doc_1 to _n, and the lists as JSON.

    retrieval_candidates holds all candidates in order of retrieval, matches the
    kept ones in order of their final rank; both are what a later run can rank anew.
    """
    seen = lambda c: F.count(c).alias(f"{c.split('_')[0]}_candidate_count")
    listed = lambda rank, *more: F.to_json(F.array_sort(F.collect_list(F.struct(rank, *[c for c in CANDIDATE if c != rank], *more))))
    found = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("retrieval_candidate_count"), seen("keyword_rank"), seen("semantic_rank"), listed("retrieval_rank", "doc_text").alias("retrieval_candidates"))
    wide = [F.max(F.when(F.col("final_rank") == i, F.col("display"))).alias(f"Matched_Doc_{i}") for i in range(1, shown + 1)]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), "|")
    kept = best.groupBy("key").agg(ids.alias("Matched_Doc_IDs"), *wide, listed("final_rank", "pair_score").alias("matches"))
    own = [c for c in requirements.columns if c != "vector"]
    out = requirements.select(*own).join(found, "key", "left").join(kept, "key", "left")
    out = out.fillna(0, [f"{c}_candidate_count" for c in ("retrieval", "keyword", "semantic")]).fillna("[]", ["retrieval_candidates", "matches"])
    return out.fillna("", ["Matched_Doc_IDs", *[f"Matched_Doc_{i}" for i in range(1, shown + 1)]])


def match_run(requirements: DataFrame, catalog: DataFrame, scorer: PairScorer, retrieved: int = RETRIEVED, shown: int = SHOWN) -> DataFrame:
    """run_records of a run over the whole catalogue."""
    candidates = settled(candidates_of(requirements, catalog, retrieved))
    return run_records(requirements, candidates, settled(ranked_anew(candidates, requirements, scorer, shown)), shown)


def rerank_run(run: DataFrame, scorer: PairScorer, retrieved: int = RETRIEVED, shown: int = SHOWN) -> DataFrame:
    """A stored run (key, query, retrieval_candidates) with its candidates, up to `retrieved`, ranked anew; nothing is retrieved."""
    shape = "array<struct<retrieval_rank:int,doc_id:bigint,display:string,keyword_rank:int,keyword_score:double,semantic_rank:int,semantic_score:double,rrf:double,doc_text:string>>"
    candidates = run.select("key", F.explode(F.from_json("retrieval_candidates", shape)).alias("c")).select("key", "c.*").filter(F.col("retrieval_rank") <= retrieved)
    own = [c for c in run.columns if not c.endswith("_candidate_count") and not c.startswith("Matched_Doc_") and c not in ("retrieval_candidates", "matches")]
    candidates = settled(candidates)
    return run_records(run.select(*own), candidates, settled(ranked_anew(candidates, run, scorer, shown)), shown)

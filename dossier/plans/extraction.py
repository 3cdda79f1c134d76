"""Model extraction with stand-in models, and approximate vector search measured against the exact one."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import extraction as X
from dossier.operators import retrieval as R
from dossier.plans.registry import Tables, query


class Lengths:
    """Gives the length of a text as JSON in a fence, sure of long ones only; no usable answer to a question mark."""

    def judge(self, payloads: Sequence[str]) -> list[str]:
        return ["none" if p == "?" else "```json\n" + json.dumps({"size": len(p), "confidence": min(100, len(p))}) + "\n```" for p in payloads]


class Echo:
    def judge(self, payloads: Sequence[str]) -> list[str]:
        return [f"seen {len(p)}" for p in payloads]


class Doubles:
    """Answers all but every third id of a batch, and one that nobody asked about."""

    def judge(self, payloads: Sequence[str]) -> list[str]:
        return [json.dumps([{"id": x["id"], "twice": 2 * x["item"]} for x in json.loads(p) if x["id"] % 3] + [{"id": -1, "twice": 0}]) for p in payloads]


@query("""SELECT c_custkey, CASE WHEN t <> '?' THEN length(t) END AS size, t = '?' AS failed, CASE WHEN length(t) < 70 THEN 'seen ' || length(t) END AS verdict
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE repeat(c_mktsegment, (1 + c_custkey % 12)::INT) END AS t FROM customer)""")
def extracted_chunks(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "?").otherwise(F.expr("repeat(c_mktsegment, int(1 + c_custkey % 12))")).alias("payload"))
    found = X.extracted(rows, Lengths(), "size int, confidence int")
    asked = X.needs_second_look(F.col("found.confidence"), F.lit(False), F.col("failed"))
    return X.verified_extraction(found, asked, Echo()).select("c_custkey", "found.size", "failed", "verdict")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 2 * p_size END AS twice, p_partkey % 3 <> 0 AS answered FROM part")
def answers_of_groups(t: Tables) -> DataFrame:
    out = X.answers_of_groups(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_partkey", F.col("p_size"), Doubles(), "id bigint, twice int", 7)
    return out.select("p_partkey", F.col("answer.twice").alias("twice"), "answered")


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, true AS reached FROM embeddings")
def vector_index_recall(t: Tables) -> DataFrame:
    """Whether the index finds nine tenths of what the exact search finds, ten best each."""
    index = R.VectorIndex.fit(t.embeddings, "vec_id", "embedding")
    asked = t.embeddings.filter("vec_id % 20 = 0")
    found = index.top_k(index.assigned(t.embeddings), asked, 10).select("query_id", "doc_id")
    true = R.vector_top_k(t.embeddings, asked, 10, "vec_id", "embedding").select("query_id", "doc_id")
    hits = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))

"""Selection metrics, pools, judged pairs and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import evaluation as E
from dossier.plans.registry import Tables, query

SETS = """tr AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 40))) AS t FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 GROUP BY 1), pr AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 40))) AS p FROM orders WHERE o_orderpriority < '3' GROUP BY 1),
bo AS (SELECT o_custkey, coalesce(t, []) AS t, coalesce(p, []) AS p FROM tr FULL JOIN pr USING (o_custkey)), h AS (SELECT *, len(list_intersect(t, p)) AS n_hit FROM bo)"""
TAIL = """list_sort(list_filter(t, lambda x: NOT list_contains(p, x))) AS missing, list_sort(list_filter(p, lambda x: NOT list_contains(t, x))) AS unexpected"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.orders.select("o_custkey", (F.col("o_orderkey") % 40).alias("item"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rows.filter("o_orderstatus <> 'P' and o_totalprice > 100000"), rows.filter("o_orderpriority < '3'")


@query(f"""WITH {SETS}, m AS (SELECT *, CASE WHEN len(p) = 0 THEN CASE WHEN len(t) > 0 THEN NULL ELSE 1.0 END ELSE n_hit / len(p) END::DOUBLE AS pp, CASE WHEN len(t) > 0 THEN n_hit / len(t) END::DOUBLE AS rr FROM h)
SELECT o_custkey, len(t) AS n_truth, len(p) AS n_predicted, n_hit, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) WHEN pp + rr = 0 THEN 0.0 END, 6) AS f1, {TAIL} FROM m""")
def set_prf1(t: Tables) -> DataFrame:
    return E.set_metrics(*_sides(t), ["o_custkey"], "item")


@query(f"""WITH {SETS}, m AS (SELECT *, CASE WHEN len(p) = 0 THEN 1.0 ELSE n_hit / len(p) END::DOUBLE AS pp, CASE WHEN len(t) > 0 THEN n_hit / len(t) ELSE 1.0 END::DOUBLE AS rr FROM h)
SELECT o_custkey, len(t) AS n_truth, len(p) AS n_predicted, n_hit, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) WHEN pp + rr = 0 THEN 0.0 END, 6) AS f1, {TAIL} FROM m""")
def set_prf1_selector(t: Tables) -> DataFrame:
    return E.set_metrics(*_sides(t), ["o_custkey"], "item", empty_prediction_is_right=True)


@query("""WITH g AS (SELECT l_suppkey AS scope, l_partkey AS doc, list_sort(list_distinct(list(l_orderkey))) AS evidence, min(l_linenumber) AS best_rank FROM lineitem GROUP BY 1, 2)
SELECT scope, doc, evidence, best_rank, len(evidence) AS n_evidence, row_number() OVER (PARTITION BY scope ORDER BY len(evidence) DESC, best_rank, doc) AS position FROM g""")
def doc_level_rollup(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("scope"), F.col("l_partkey").alias("doc"), "l_orderkey", "l_linenumber")
    return E.document_rollup(rows, "scope", "doc", "l_orderkey", "l_linenumber")


@query("""WITH g AS (SELECT l_suppkey % 10 AS scope, l_partkey AS doc, list_sort(list_distinct(list(l_orderkey))) AS evidence, min(CASE WHEN l_linenumber > 3 THEN l_linenumber END) AS best_rank, min('N' || l_partkey % 7) AS docno, min(trim(coalesce(p_name, ''))) AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT scope, doc, best_rank, docno, title, len(evidence) AS n_evidence, row_number() OVER (PARTITION BY scope ORDER BY len(evidence) DESC, coalesce(best_rank, 1000000000), docno, title, doc) AS position FROM g""")
def rollup_by_number_and_title(t: Tables) -> DataFrame:
    """Equal evidence and rank go by document number, then title; ranks of 0 and below are none."""
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = rows.select((F.col("l_suppkey") % 10).alias("scope"), F.col("l_partkey").alias("doc"), "l_orderkey", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).otherwise(-1).alias("rank"), F.concat(F.lit(" N"), F.col("l_partkey") % 7).alias("docno"), F.col("p_name").alias("title"))
    return E.document_rollup(rows, "scope", "doc", "l_orderkey", "rank", ["docno", "title"]).drop("evidence")


QREL = "q AS (SELECT l_orderkey % 500 AS query_id, l_partkey % 50 AS doc_id, greatest(0, least(3, l_linenumber - 2)) AS relevance FROM lineitem)"


def _qrels(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") % 500).alias("query_id"), (F.col("l_partkey") % 50).alias("doc_id"), (F.col("l_linenumber") - 2).alias("relevance"))


@query(f"WITH {QREL} SELECT query_id, doc_id FROM q GROUP BY 1, 2 HAVING min(relevance) <> max(relevance)")
def qrels_conflicts(t: Tables) -> DataFrame:
    return E.checked_qrels(_qrels(t), ["query_id", "doc_id"])[1]


@query(f"WITH {QREL} SELECT query_id, doc_id, min(relevance) AS relevance FROM q GROUP BY 1, 2 HAVING min(relevance) = max(relevance)")
def qrels_clean(t: Tables) -> DataFrame:
    return E.checked_qrels(_qrels(t), ["query_id", "doc_id"])[0]


@query("""SELECT p_brand, p_type, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY pos) AS r FROM (SELECT *, p_partkey AS pos FROM part WHERE p_size <= 25 UNION ALL SELECT *, p_partkey + 100000 AS pos FROM part WHERE p_size > 10)) WHERE r = 1""")
def pool_union_dedup(t: Tables) -> DataFrame:
    a = t.part.filter("p_size <= 25").withColumn("pos", F.col("p_partkey"))
    b = t.part.filter("p_size > 10").withColumn("pos", F.col("p_partkey") + 100000)
    return E.first_of_key(a.unionByName(b), ["p_brand", "p_type"], "pos").select("p_brand", "p_type", "p_partkey", "p_name")


@query("""WITH s AS (SELECT doc_id, quality, toxic, count(*) OVER w AS n, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('7:' || doc_id), doc_id) AS r FROM labels WINDOW w AS (PARTITION BY quality, toxic))
SELECT doc_id, quality, toxic, CASE WHEN r <= least(greatest(1, round_even(n * 0.2, 0)::INT), n - 1) THEN 'dev' ELSE 'train' END AS split FROM s""")
def stratified_split(t: Tables) -> DataFrame:
    return E.split_stratified(t.labels.select("doc_id", "quality", "toxic"), ["quality", "toxic"], "doc_id", 0.2, 7)


@query("""SELECT l_orderkey AS query_id, l_linenumber AS doc_id, l_partkey AS ref FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE least(3, l_linenumber) = 3 AND o_orderstatus = 'F' AND CASE o_orderpriority WHEN '1-URGENT' THEN 3 ELSE 2 END = 3""")
def verification_join(t: Tables) -> DataFrame:
    judged = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), F.col("l_partkey").alias("ref"), F.least(F.lit(3), F.col("l_linenumber")).alias("relevance"))
    check = t.orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(2).alias("relevance"), (F.col("o_orderstatus") == "F").alias("agrees"))
    return E.verified(judged, check, ["query_id"]).select("query_id", "doc_id", "ref")


@query("""SELECT o_orderkey, unnest(string_split(o_orderkey || '|' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN '|x' ELSE '' END, '|')) AS chunk_id FROM orders""")
def evidence_explode(t: Tables) -> DataFrame:
    joined = F.concat_ws("|", "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "x"))
    return E.explode_evidence(t.orders.select("o_orderkey", joined.alias("c")), "c").drop("c")

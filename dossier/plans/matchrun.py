"""Match runs over the driver tables, and records around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import match_run as M
from dossier.operators import records as Q
from dossier.operators import registers as G
from dossier.operators.providers import OverlapScorer
from dossier.plans.registry import Tables, query
from dossier.plans.retrieval import BM25
from dossier.sources import files as S
from dossier.sources.office import taxonomy

_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
RUN = f"""{BM25},
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
cs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q, v d WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM documents)),
ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs),
kk AS (SELECT query_id, doc_id, rank AS keyword_rank FROM bt WHERE rank <= 30 AND query_id % 9 <> 0), ss AS (SELECT query_id, doc_id, rank AS semantic_rank FROM ct WHERE rank <= 30 AND query_id % 9 <> 0),
hy AS (SELECT query_id, doc_id, keyword_rank, semantic_rank, round(coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 9) AS rrf FROM kk FULL JOIN ss USING (query_id, doc_id)),
hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(keyword_rank, 1073741824), doc_id) AS retrieval_rank FROM hy) WHERE retrieval_rank <= 30),
tq AS (SELECT item_id AS query_id, {_TOKENS.format("text")} AS qt FROM benchmark), td AS (SELECT doc_id, {_TOKENS.format("text")} AS dt FROM documents),
ps AS (SELECT hr.*, round(len(list_intersect(qt, dt)) / greatest(1, len(qt)), 6) AS pair_score FROM hr JOIN tq USING (query_id) JOIN td USING (doc_id)),
cn AS (SELECT query_id, count(*) AS n, count(keyword_rank) AS nk, count(semantic_rank) AS ns FROM hr GROUP BY 1)"""


def _run(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = t.benchmark.select(F.col("item_id").alias("key"), F.col("text").alias("query"), F.when(F.col("item_id") % 9 == 0, "no").otherwise("").alias("is_candidate")).join(vectors, F.col("key") == F.col("id"), "left").drop("id")
    docs = t.documents.select("doc_id", "text", F.concat(F.lit("D"), "doc_id").alias("display")).join(vectors, F.col("doc_id") == F.col("id"), "left").drop("id")
    return M.match_run(asked, docs, OverlapScorer(), 30, 5)


def _shown(run: DataFrame) -> DataFrame:
    first = F.get_json_object("matches", "$[0].doc_id").cast("long").alias("first_match")
    return run.select("key", "retrieval_candidate_count", "keyword_candidate_count", "semantic_candidate_count", "Matched_Doc_1", "Matched_Doc_5", "Matched_Doc_IDs", first)


def _wide(most: int, source: str) -> str:
    return f"""fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, retrieval_rank) AS final_rank FROM {source}) WHERE final_rank <= {most}),
wi AS (SELECT query_id, string_agg(doc_id::VARCHAR, '|' ORDER BY final_rank) AS ids, max(CASE WHEN final_rank = 1 THEN doc_id END) AS a, max(CASE WHEN final_rank = 5 THEN doc_id END) AS e FROM fr GROUP BY 1)
SELECT item_id AS key, coalesce(n, 0) AS retrieval_candidate_count, coalesce(nk, 0) AS keyword_candidate_count, coalesce(ns, 0) AS semantic_candidate_count, coalesce('D' || a, '') AS "Matched_Doc_1", coalesce('D' || e, '') AS "Matched_Doc_5",
  coalesce(ids, '') AS "Matched_Doc_IDs", a AS first_match FROM benchmark LEFT JOIN cn ON cn.query_id = item_id LEFT JOIN wi ON wi.query_id = item_id"""


@query(f"WITH {RUN}, {_wide(5, 'ps')}")
def match_run(t: Tables) -> DataFrame:
    """Items against documents by words and vectors, fused, scored in pairs; every ninth item is no candidate and keeps an empty row."""
    return _shown(_run(t))


@query(f"WITH {RUN}, p8 AS (SELECT * FROM ps WHERE retrieval_rank <= 8), c8 AS (SELECT query_id, count(*) AS n, count(keyword_rank) AS nk, count(semantic_rank) AS ns FROM p8 GROUP BY 1), {_wide(5, 'p8').replace('LEFT JOIN cn ON cn', 'LEFT JOIN c8 ON c8')}")
def reranked_run(t: Tables) -> DataFrame:
    """The run's eight first candidates ranked anew from its JSON, without another look at the catalogue."""
    return _shown(M.rerank_run(_run(t), OverlapScorer(), 8, 5))


@query("""SELECT o_orderkey, '{"document":"doc","chunk_id":"c' || o_orderkey || '","pages":[' || o_custkey % 7 || '],"section":"3","chunk_type":"text","hierarchy_context":"H","llm_output":' || CASE WHEN o_orderkey % 2 = 0 THEN '{"a":' || o_custkey || '}' ELSE '{}' END || ',"llm_verification":{},"token_usage":"' || o_custkey || '"' ||
CASE WHEN o_orderstatus = 'F' THEN ',"error":"late"' ELSE '' END || '}' AS record, CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'false' END AS needs_review, 'A > B' AS section_path, '0.5' AS confidence, 'x, y' AS label, CASE o_orderstatus WHEN 'P' THEN 'why' ELSE '' END AS reason FROM orders""")
def whole_requirement_records(t: Tables) -> DataFrame:
    """Flat rows with what the model said of itself, and the JSON record of each chunk; an output that is no JSON is an empty object."""
    k, status = F.col("o_custkey"), F.col("o_orderstatus")
    rows = t.orders.select(
        "o_orderkey", "o_orderstatus", F.lit("doc").alias("document"), F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.array(k % 7).alias("page_num"), F.lit("3").alias("section"), F.lit("H").alias("hierarchy"), F.array(F.lit("d")).alias("depths"),
        F.array(F.lit("a")).alias("keywords"), F.lit("").alias("candidate"), F.lit("").alias("skip_reason"), F.lit("t").alias("text"), F.lit("text").alias("chunk_type"), k.cast("string").alias("token_usage"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))).otherwise("sorry").alias("output"), F.when(status == "F", "late").otherwise(" ").alias("error"),
    )
    record = Q.requirement_json(rows).withColumn("o_orderkey", F.substring("chunk_id", 2, 20).cast("long")).select("o_orderkey", "record")
    told = rows.select("*", F.lit(" A > B").alias("section_path"), F.array(F.lit("x"), F.lit(" y")).alias("label"), F.lit(0.5).alias("confidence"), (status == "O").alias("needs_review"), F.when(status == "P", "why").alias("reason"))
    flat = Q.requirement_records(told, 1).withColumn("o_orderkey", F.substring("chunk_id", 2, 20).cast("long"))
    return flat.select("o_orderkey", "needs_review", "section_path", "confidence", "label", "reason").join(record, "o_orderkey")


@query("SELECT DISTINCT l_orderkey, l_partkey, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'")
def pooled_pairs(t: Tables) -> DataFrame:
    """Pairs whose requirement is known, without what ranked them."""
    pool = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("bm25_score"), F.col("l_linenumber").alias("final_rank"))
    return G.pool_pairs(pool, t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), ["l_orderkey"]).distinct()


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Vendor' ELSE 'EPC' END AS scope FROM part""")
def inferred_scopes(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", "p_name", F.element_at(F.array(F.lit("data sheet"), F.lit("layout"), F.lit(None)), (F.col("p_partkey") % 3 + 1).cast("int")))
    return t.part.select("p_partkey", G.inferred_scope(title).alias("scope"))


@query("""SELECT p_partkey, 'name' AS "column", ' ' || p_name || chr(160) || 'x' || chr(10) || 'rest' AS before, p_name || ' x' AS after FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'brand', p_brand || ' ', p_brand FROM part WHERE p_partkey % 5 = 0""")
def cleaned_rule_cells(t: Tables) -> DataFrame:
    """First lines, plain blanks, trimmed; a change row for each cell that differs."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(" x\nrest"))).otherwise(F.col("p_name"))
    raw = t.part.select("p_partkey", name.alias("name"), F.when(k % 5 == 0, F.concat("p_brand", F.lit(" "))).otherwise(F.col("p_brand")).alias("brand"))
    return S.clean_rules(raw, ["name", "brand"], "p_partkey")[1]


@query("SELECT DISTINCT p_brand AS source_file, unnest([p_type, lower(p_type) || '/x', p_name]) AS term FROM part")
def taxonomy_terms(t: Tables) -> DataFrame:
    """Terms of list paragraphs: marks dropped, commas, semicolons and spaced slashes part them."""
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "• ").otherwise("1.2 "), "p_type", F.lit(" , "), F.lower("p_type"), F.lit("/x;"), "p_name")
    return taxonomy(t.part.select(F.col("p_brand").alias("source_file"), text.alias("text")))

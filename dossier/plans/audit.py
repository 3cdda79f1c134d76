"""Audits against judged pairs and inference ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import audit as A
from dossier.operators import standard_list as B
from dossier.plans.registry import Tables, query
from dossier.plans.wording import TITLED, titled_parts

_S = "(' ' || trim(regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g')) || ' ')"
_R = "[" + ", ".join(f"'{t}'" for t in A.RULE_SCOPES) + "]"


@query(f"""WITH {TITLED}, s AS (SELECT p_partkey, {_S} AS s FROM tp)
SELECT p_partkey, list_sort(list_distinct(list_concat(list_filter([{', '.join(f"CASE WHEN contains(s, ' {p} ') THEN '{k}' END" for k, p in A.RULE_SCOPE_PHRASES)}], lambda x: x IS NOT NULL), list_filter(string_split(lower(trim(s)), ' '), lambda x: list_contains({_R}, x))))) AS scopes,
list_sort(list_filter(list_distinct(string_split(lower(trim(s)), ' ')), lambda x: NOT list_contains({_R}, x) AND x <> 'for' AND length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$'))) AS tokens FROM s""")
def rule_scope_tokens(t: Tables) -> DataFrame:
    return titled_parts(t).select("p_partkey", A.rule_scope_keys("title").alias("scopes"), A.free_tokens("title", ("for",)).alias("tokens"))


def _ladder(table, otherwise: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(title), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in table) + f" ELSE '{otherwise}' END"


@query(f"""WITH {TITLED}, f AS (SELECT p_partkey, title, {_ladder(A.DOC_TYPES, 'General')} AS doc_type, {_ladder(A.DISCIPLINES, 'General')} AS discipline FROM tp)
SELECT p_partkey, doc_type, discipline, CASE WHEN doc_type = 'Data Sheet' OR contains(upper(title), 'VENDOR') OR contains(upper(title), 'SHOP DRAWING') THEN 'Vendor' ELSE 'EPC' END AS scope_type, title AS subject FROM f""")
def standard_inference(t: Tables) -> DataFrame:
    return titled_parts(t).select("p_partkey", A.standard_facets("title").alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_brand ELSE 'General' END AS equipment, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type || ' ' || p_name ELSE p_brand || ' ' || p_name END AS levels FROM part""")
def fallback_chain(t: Tables) -> DataFrame:
    s = F.col("p_size")
    value = A.first_filled(F.when(s % 2 == 0, F.col("p_name")).otherwise(" "), F.when(s % 3 == 0, F.col("p_brand")))
    path = F.concat_ws(" > ", F.lit("Plant"), F.lit("Unit"), "p_brand", F.when(s % 2 == 0, F.col("p_type")).otherwise("General"), "p_name")
    return t.part.select("p_partkey", value.alias("equipment"), T.last_levels(path, ("GENERAL", "PLANT", "UNIT"), 3).alias("levels"))


QREL = "q AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS doc_id FROM lineitem WHERE l_discount >= 0.05), g AS (SELECT o_orderkey AS id, [o_orderkey, o_orderkey + 1] AS chunks, o_custkey AS doc_id FROM orders)"


def _judged(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("doc_id"), F.when(F.col("l_discount") >= 0.05, 3).otherwise(1).alias("relevance"))


@query(f"WITH {QREL}, e AS (SELECT id, doc_id, unnest(chunks) AS chunk_id FROM g) SELECT e.id, bool_or(q.doc_id IS NOT NULL) AS exact_hit FROM e LEFT JOIN q USING (chunk_id, doc_id) GROUP BY 1")
def exact_hits(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("id"), F.array(k, k + 1).alias("chunks"), F.col("o_custkey").alias("doc_id"))
    return A.exact_hits(rows, _judged(t), "id", "chunks", "doc_id")


@query(f"WITH {QREL} SELECT chunk_id, doc_id FROM q WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = chunk_id AND l_partkey = doc_id AND l_tax < 0.03)")
def missing_truth(t: Tables) -> DataFrame:
    kept = t.lineitem.filter("l_tax < 0.03").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("doc_id"))
    return A.missing_truth(_judged(t), kept)


@query("""SELECT l_orderkey AS chunk_id, l_partkey AS doc_id, min(l_linenumber) AS rank, arg_min(CASE WHEN l_returnflag = 'A' THEN l_discount WHEN l_returnflag = 'R' THEN l_tax ELSE 0.0 END, (l_linenumber, l_suppkey)) AS score FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_suppkey) = 1) GROUP BY 1, 2""")
def raw_match_index(t: Tables) -> DataFrame:
    one = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min_by(F.struct("l_returnflag", "l_discount", "l_tax"), "l_suppkey").alias("x"))
    semantic, fused = F.when(F.col("x.l_returnflag") == "A", F.col("x.l_discount")), F.when(F.col("x.l_returnflag") == "R", F.col("x.l_tax"))
    return A.best_raw_match(one.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), semantic.alias("semantic_score"), fused.alias("rrf_score"), F.lit(None).cast("double").alias("pair_score")))


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS hits, round(count(*) FILTER (o_orderkey % 3 = 0) / count(*), 6) AS hit_rate, count(*) FILTER (o_totalprice > 100000) AS usable, round(count(*) FILTER (o_totalprice > 100000) / count(*), 6) AS usable_rate, count(*) FILTER (o_orderstatus = 'F') AS generated FROM orders""")
def schedule_summary(t: Tables) -> DataFrame:
    return A.schedule_summary(t.orders.select((F.col("o_orderkey") % 3 == 0).alias("exact_hit"), (F.col("o_totalprice") > 100000).alias("usable"), F.when(F.col("o_orderstatus") == "F", "generated").otherwise("skip").alias("date_status")))


@query("""WITH x AS (SELECT CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN p_name || ' unit 3' ELSE p_name END AS title, p_brand, p_type FROM part), y AS (SELECT *, count(*) OVER (PARTITION BY p_brand, title) AS n FROM x)
SELECT unnest(['blank_title', 'duplicate_title', 'unknown_scope', 'qualifier_left']) AS "check", unnest([count(*) FILTER (title = ''), count(*) FILTER (n > 1), count(*) FILTER (p_type NOT IN ('PROMO', 'ECONOMY')), count(*) FILTER (title LIKE '% unit 3')]) AS n FROM y""")
def output_checks(t: Tables) -> DataFrame:
    s = F.col("p_size")
    title = F.when(s == 1, "").when(s == 2, F.concat("p_name", F.lit(" unit 3"))).otherwise(F.col("p_name"))
    return A.output_checks(t.part.select(title.alias("title"), "p_brand", "p_type"), "title", "p_brand", "p_type", ("PROMO", "ECONOMY"))


@query()
def standard_ladders(t: Tables) -> DataFrame:
    """All ladders of the standard list, with structured fields in some rows."""
    s = F.col("p_size")
    fields = {"equipment": F.when(s % 4 == 1, F.col("p_name")), "building": F.when(s % 5 == 1, F.col("p_brand")), "system": F.when(s % 3 == 0, F.col("scope")), "study": F.when(s % 7 == 0, "HAZOP"), "others": F.when(s % 11 == 0, "Spares for CVP"), "deliverable": F.when(s % 2 == 0, "GA drawing")}
    rows = titled_parts(t).drop("deliverable").join(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    return B.with_standard_facets(rows.select("p_partkey", "title", *[c.alias(k) for k, c in fields.items()]))

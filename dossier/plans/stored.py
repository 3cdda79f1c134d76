"""Catalogues and indexes that are stored, merged and asked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import listing as L
from dossier.operators import register_cleaning as C
from dossier.plans.cases import case_rows, expected_rows
from dossier.plans.registry import Tables, query
from dossier.plans.retrieval import BM25
from dossier.sources.scratch import scratch_folder
from dossier.sources.stored import KeyedTable, KeywordIndex, latest


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN 'second' ELSE 'first' END AS run, CASE WHEN p_partkey % 3 <> 1 THEN round(p_retailprice + 1, 2) ELSE round(p_retailprice, 2) END AS price,
CASE WHEN p_partkey % 3 <> 1 THEN p_brand END AS brand FROM part""")
def stored_upserts(t: Tables) -> DataFrame:
    """Two runs into one stored catalogue: the second replaces some keys, adds others and brings a column; repeated rows of a key give way to the last."""
    table, k = KeyedTable(t.spark, scratch_folder(t.spark), "p_partkey"), F.col("p_partkey") % 3
    row = lambda run, more, *columns: t.part.select("p_partkey", F.lit(run).alias("run"), F.round(F.col("p_retailprice") + more, 2).alias("price"), *columns)
    first = row("first", 0, F.lit(2).alias("at")).filter(k < 2)
    table.upsert(first.unionByName(first.withColumns({"at": F.lit(1), "price": F.lit(0.0)})), lambda held, new: latest("p_partkey", "at")(held, new).drop("at"))
    table.upsert(row("second", 1, "p_brand", F.lit(1).alias("at")).filter(k != 1).withColumnRenamed("p_brand", "brand"), lambda held, new: latest("p_partkey", "at")(held, new).drop("at"))
    return table.read().select("p_partkey", "run", "price", "brand")


@query(f"WITH {BM25} SELECT query_id, doc_id, rank, score FROM bt WHERE rank <= 20")
def stored_index_topk(t: Tables) -> DataFrame:
    """The index of one half of the documents takes the other half as a segment; then every item is asked."""
    index = KeywordIndex(t.spark, scratch_folder(t.spark), "doc_id", ["text"])
    half = F.col("doc_id") % 2 == 0
    index.open(t.documents.filter(half))
    index.append(t.documents.filter(~half))
    index.open(t.documents)  # there is one of these properties: nothing to build
    return index.top_k(t.benchmark, 20, "item_id", "text").select("query_id", "doc_id", "rank", "score")


_MERGED = {"p_brand": " | ", "p_type": " ; "}


@query("""WITH r AS (SELECT lower(p_name) AS title_key, p_name, p_brand, p_type, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000000 END AS pos FROM part),
b AS (SELECT title_key, string_agg(v, ' | ' ORDER BY p) AS brands FROM (SELECT title_key, p_brand AS v, min(pos) AS p FROM r GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT title_key, string_agg(v, ' ; ' ORDER BY p) AS types FROM (SELECT title_key, p_type AS v, min(pos) AS p FROM r GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT title_key, arg_min(p_name, pos) AS title, min(pos) AS first_position, count(*) AS n_rows FROM r GROUP BY 1)
SELECT title_key, title, first_position, n_rows, brands AS p_brand, types AS p_type, 'title_' || sha1(title_key)[1:12] AS doc_id FROM m JOIN b USING (title_key) JOIN t USING (title_key)""")
def ingest_in_two_steps(t: Tables) -> DataFrame:
    """The second register joins the stored titles without a look at the first one's rows; the result is that of one ingest of both."""
    table = KeyedTable(t.spark, scratch_folder(t.spark), "title_key")
    for number in (0, 1):
        rows = t.part.filter(F.col("p_partkey") % 2 == number).withColumn("position", F.col("p_partkey") + number * 1_000_000_000)
        table.upsert(L.title_state(rows, "p_name", "position", list(_MERGED)), L.merged_states)
    return L.titles_of(table.read(), _MERGED)


#: title, others, equipment, system, building, deliverable; then the fields, actions, confidence, status, sources, conflicts, review.
REGISTER_ROWS = (
    (("PROCESS FLOW DIAGRAM FOR CCW SYSTEM", "", "", "", "", ""), "/Closed Cooling Water System//Diagram/canonicalized_existing_fields;filled_system_from_scope:ccw/0.80/auto_cleaned/system:title_or_others//false"),
    (("HRSG DESIGN REPORT", "", "HRSG", "report", "", ""), "Heat Recovery Steam Generator///DESIGN REPORT/canonicalized_existing_fields;cleared_deliverable_value_from_system/0.90/auto_cleaned///false"),
    (("DCS CABLE LIST", "", "", "Service Water System", "", "LIST"), "/Service Water System//LIST//0.35/conflict//structured_scope_conflict:existing=service_water;detected=dcs/true"),
    (("SITE PLAN", "", "", "", "", "PLAN"), "/Plant General System//Plan/canonicalized_existing_fields;assigned_plant_general_scope/0.75/plant_general/system:plant_general_title//false"),
    (("-", None, None, None, None, None), "////flagged_garbage_title/0.20/invalid_title///true"),
    (("HRSG and STG outline", "", "", "", "Security Building", ""), "Heat Recovery Steam Generator//Security Building/OUTLINE/canonicalized_existing_fields;filled_equipment_from_scope:hrsg/0.35/conflict/equipment:title_or_others/structured_scope_conflict:existing=hrsg;detected=stg/true"),
    (("Pump in pipe rack", "", "Pump (old) | Boiler Feed Water Pump", "", "STORAGE BUILDING", "nan"), "Boiler Feed Water Pump//Workshop & Storage Building//canonicalized_existing_fields/0.35/conflict//building_conflict:Workshop & Storage Building!=detected:Pipe Rack/true"),
    (("cover", "", "X", "list", "", ""), "X///list/moved_system_value_to_deliverable/0.90/auto_cleaned///false"),
)


@query(expected_rows([found for _, found in REGISTER_ROWS]))
def cleaned_registers(t: Tables) -> DataFrame:
    """What titles tell fills what is blank, step after step; nothing that is there is overwritten, clashes are named."""
    rows = C.cleaned_register(case_rows(t, "title others equipment system building deliverable", [r for r, _ in REGISTER_ROWS]))
    return rows.select("p_partkey", "case_id", F.concat_ws("/", *C.FIELDS, "cleaning_actions", "cleaning_confidence", "scope_status", "scope_fill_source", "scope_conflict_reason", "needs_human_review").alias("found"))


@query("""WITH s AS (SELECT p_partkey % 8 AS k FROM part), n AS (SELECT k, count(*) AS c FROM s GROUP BY 1),
e AS (SELECT * FROM (VALUES (0, 'scope_status:auto_cleaned'), (0, 'action:canonicalized_existing_fields'), (0, 'action:filled_system_from_scope'), (1, 'scope_status:auto_cleaned'), (1, 'action:canonicalized_existing_fields'), (1, 'action:cleared_deliverable_value_from_system'),
(2, 'scope_status:conflict'), (2, 'needs_human_review'), (2, 'rows_with_conflict'), (3, 'scope_status:plant_general'), (3, 'action:canonicalized_existing_fields'), (3, 'action:assigned_plant_general_scope'), (4, 'scope_status:invalid_title'), (4, 'needs_human_review'), (4, 'action:flagged_garbage_title'),
(5, 'scope_status:conflict'), (5, 'needs_human_review'), (5, 'rows_with_conflict'), (5, 'action:canonicalized_existing_fields'), (5, 'action:filled_equipment_from_scope'), (6, 'scope_status:conflict'), (6, 'needs_human_review'), (6, 'rows_with_conflict'), (6, 'action:canonicalized_existing_fields'),
(7, 'scope_status:auto_cleaned'), (7, 'action:moved_system_value_to_deliverable')) v(k, name) UNION ALL SELECT k, 'rows' FROM n)
SELECT name, sum(c)::BIGINT AS n FROM e JOIN n USING (k) GROUP BY 1""")
def cleaning_counts(t: Tables) -> DataFrame:
    return C.cleaning_summary(C.cleaned_register(case_rows(t, "title others equipment system building deliverable", [r for r, _ in REGISTER_ROWS])))

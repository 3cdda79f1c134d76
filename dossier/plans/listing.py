"""Dedup, consolidation and list building over parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ranked
from dossier.operators import listing as L
from dossier.plans.registry import Tables, query

DISTINCT = "array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(p := p, v := v)))), lambda s: s.v), '{sep}')"


def _joined(value: str, sep: str) -> str:
    """Ordered distinct values of a group as one string; rows are (title_key, pos, value)."""
    return f"(SELECT string_agg(v, '{sep}' ORDER BY p) FROM (SELECT {value} AS v, min(pos) AS p FROM r x WHERE x.title_key = r.title_key AND {value} <> '' GROUP BY 1))"


@query("""WITH r AS (SELECT lower(p_name) AS title_key, p_name, p_brand, p_type, p_partkey AS pos FROM part),
b AS (SELECT title_key, string_agg(v, ' | ' ORDER BY p) AS brands FROM (SELECT title_key, p_brand AS v, min(pos) AS p FROM r GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT title_key, string_agg(v, ' ; ' ORDER BY p) AS types FROM (SELECT title_key, p_type AS v, min(pos) AS p FROM r GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT title_key, arg_min(p_name, pos) AS p_name, min(pos) AS first_position, count(*) AS n_rows FROM r GROUP BY 1)
SELECT title_key, p_name, first_position, n_rows, brands AS p_brand, types AS p_type, 'title_' || sha1(title_key)[1:12] AS doc_id FROM m JOIN b USING (title_key) JOIN t USING (title_key)""")
def title_dedup_merge(t: Tables) -> DataFrame:
    return L.merge_titles(t.part.select("p_name", "p_brand", "p_type", F.col("p_partkey").alias("position")), "p_name", "position", {"p_brand": " | ", "p_type": " ; "})


@query("""WITH k AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'doc_id:' || p_size WHEN p_partkey % 3 = 1 THEN 'source_doc:' || p_brand || '|' || p_size ELSE 'title:' || upper(p_name) END AS candidate_key, p_retailprice AS score, p_partkey AS pos, p_type, p_name FROM part)
SELECT candidate_key, arg_max(p_name, (score, -pos)) AS p_name, max(score) AS score, list(p_type ORDER BY pos, p_type) AS sources FROM k GROUP BY 1""")
def candidate_upsert(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 3
    rows = t.part.select("p_name", "p_type", F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("pos"), F.when(kind == 0, F.col("p_size").cast("string")).alias("doc_id"), F.when(kind == 1, F.col("p_brand")).alias("source"), F.when(kind == 1, F.col("p_size").cast("string")).alias("number"))
    return L.upsert_candidates(rows, L.identity_keys("doc_id", "source", "number", "p_name"), "score", "pos", "p_type", ["p_name"])


@query("""SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey, p_partkey) AS r FROM part) WHERE r = 1""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    return L.keep_first(t.part.select("p_name", "p_brand", "p_partkey"), ["p_name", "p_brand"], "p_partkey")


@query("""SELECT p_name, count(*) AS n, list_sort(list(p_partkey))[1:3] AS samples, concat_ws(';', CASE WHEN count(DISTINCT p_brand) > 1 THEN 'p_brand' END, CASE WHEN count(DISTINCT p_size) > 1 THEN 'p_size' END) AS differing FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_report(t: Tables) -> DataFrame:
    return L.duplicate_groups(t.part, ["p_name"], "p_partkey", ["p_brand", "p_size"])


@query("SELECT count(*) AS duplicate_groups, coalesce(sum(n), 0)::BIGINT AS duplicated_rows, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_type HAVING count(*) > 1)")
def duplicate_summary(t: Tables) -> DataFrame:
    return L.duplicate_summary(t.part, ["p_name", "p_type"])


@query("""WITH c AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_name, arg_min(p_brand, (-n, p_brand)) AS majority FROM c GROUP BY 1""")
def majority_value(t: Tables) -> DataFrame:
    return L.majority(t.part, ["p_name"], "p_brand")


@query("""WITH s AS (SELECT *, CASE WHEN p_size > 20 THEN 20 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 8 ELSE 0 END AS sc FROM part)
SELECT p_type, p_brand, count(*) AS n_source, arg_min(p_name, (-sc, length(p_name), p_name)) AS p_name FROM s GROUP BY 1, 2""")
def group_representative(t: Tables) -> DataFrame:
    score = F.when(F.col("p_size") > 20, 20).otherwise(0) + F.when(F.col("p_retailprice") > 1000, 8).otherwise(0)
    return L.representative(["p_type", "p_brand"], score, "p_name", ["p_name"], t.part)


CONS = """r AS (SELECT p_partkey AS pos, p_name AS title, p_type AS scope, p_brand, CASE WHEN p_size % 5 = 0 THEN 'Generic Title' WHEN p_size % 7 = 0 THEN 'Scope Mixed; Generic Title' ELSE 'OK' END AS status FROM part),
b AS (SELECT title, scope, string_agg(p_brand, ' | ' ORDER BY p) AS brands, count(*) AS nb FROM (SELECT title, scope, p_brand, min(pos) AS p FROM r GROUP BY ALL) GROUP BY 1, 2),
u AS (SELECT title, scope, pos, i, x FROM (SELECT *, string_split(status, '; ') AS xs FROM r), LATERAL (SELECT unnest(xs) AS x, generate_subscripts(xs, 1) AS i)),
s AS (SELECT title, scope, string_agg(x, '; ' ORDER BY p, i) AS st FROM (SELECT title, scope, x, min(pos) AS p, arg_min(i, (pos, i)) AS i FROM u WHERE x <> 'OK' GROUP BY ALL) GROUP BY 1, 2),
g AS (SELECT title, scope, row_number() OVER (ORDER BY title, scope) AS no FROM (SELECT DISTINCT title, scope FROM r)),
c AS (SELECT g.no, title, scope, brands, CASE WHEN nb <= 1 THEN brands ELSE 'General' END AS brand, coalesce(st, 'OK') AS status FROM g JOIN b USING (title, scope) LEFT JOIN s USING (title, scope))"""


def _consolidated(t: Tables) -> DataFrame:
    status = F.when(F.col("p_size") % 5 == 0, "Generic Title").when(F.col("p_size") % 7 == 0, "Scope Mixed; Generic Title").otherwise("OK")
    rows = t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_type").alias("scope"), F.col("p_brand").alias("brands"), F.col("p_brand").alias("brand"), status.alias("status"))
    return L.consolidate(rows, ["title", "scope"], "pos", {"brands": " | "}, ["brand"], "status")


@query(f"WITH {CONS} SELECT * FROM c")
def group_consolidate(t: Tables) -> DataFrame:
    return _consolidated(t).select("no", "title", "scope", "brands", "brand", "status")


@query(f"WITH {CONS} SELECT r.pos AS part, c.no AS new_no, c.title AS new_title FROM r JOIN c USING (title, scope)")
def renumber_audit(t: Tables) -> DataFrame:
    audit = t.part.select(F.col("p_partkey").alias("old_no"), F.col("p_partkey").alias("part"))
    return L.renumber_audit(audit, _consolidated(t), "old_no", "title").select("part", "new_no", "new_title")


@query("""SELECT p_partkey, CASE WHEN bool_or(p_type = 'ECONOMY') OVER w AND bool_or(p_type = 'PROMO') OVER w THEN p_name || ' (' || p_type || ')' ELSE p_name END AS title FROM part WINDOW w AS (PARTITION BY p_name)""")
def scope_disambiguate(t: Tables) -> DataFrame:
    return L.disambiguate(t.part.select("p_partkey", F.col("p_name").alias("title"), "p_type"), "title", "p_type", ("ECONOMY", "PROMO"), F.col("p_type")).select("p_partkey", "title")


@query("""WITH n AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_name, arg_min(p_type, (-n, p_type)) AS best FROM n GROUP BY 1) SELECT p_partkey, p_type = best AS kept FROM part JOIN b USING (p_name)""")
def conservative_merge(t: Tables) -> DataFrame:
    return L.conservative_merge(t.part.select("p_partkey", "p_name", "p_type"), "p_name", "p_type").select("p_partkey", "kept")


@query("""SELECT p_name, p_type, false AS added FROM part WHERE p_size <= 25 UNION ALL SELECT p_name, p_type, true FROM part a WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= 25 AND b.p_name = a.p_name AND b.p_type = a.p_type)""")
def add_if_absent(t: Tables) -> DataFrame:
    rows = t.part.select("p_name", "p_type", (F.col("p_size") > 25).alias("added"))
    return L.add_if_absent(rows.filter("not added"), rows.filter("added"), ["p_name", "p_type"])


REQUIRED = [(a, b) for a in ("small", "large", "blue", "plum") for b in ("ring", "widget", "panel", "hose")]


@query("WITH q AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in REQUIRED) + ") v(colour, thing)) SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM part WHERE contains(p_name, colour) AND contains(p_name, thing))")
def gap_antijoin(t: Tables) -> DataFrame:
    return L.missing_pairs(t.spark.createDataFrame(REQUIRED, "colour string, thing string"), t.part, ["colour", "thing"], "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')")
def resume_antijoin(t: Tables) -> DataFrame:
    done = t.lineitem.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT p_partkey, unnest(CASE p_type WHEN 'ECONOMY' THEN ['Data Sheet', 'Drawing'] ELSE [p_type] END) AS kind FROM part")
def composite_split(t: Tables) -> DataFrame:
    return L.composite_rows(t.part.select("p_partkey", F.col("p_type").alias("kind")), "kind", {"economy": ("Data Sheet", "Drawing")})


@query("""WITH g AS (SELECT p_name, p_type, count(*) AS n, count(DISTINCT CASE WHEN p_size > 40 THEN p_brand END) AS ne FROM part GROUP BY 1, 2),
f AS (SELECT *, p_name || ' layout' AS title, CASE WHEN p_type = 'PROMO' THEN 'Vendor' ELSE 'EPC' END AS sc FROM g)
SELECT p_name, p_type, CASE WHEN ne > 0 AND sc <> 'Vendor' AND n <= 8 THEN 'OK' ELSE concat_ws('; ', CASE WHEN ne = 0 THEN 'Generic Title' END, CASE WHEN sc = 'Vendor' THEN 'Scope Mixed' END, CASE WHEN n > 8 THEN 'Possible Over-Merge' END) END AS status FROM f""")
def initial_validation(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("p_size") > 40, F.col("p_brand"))).alias("ne"))
    status = L.initial_status(F.concat("p_name", F.lit(" layout")), F.when(F.col("p_type") == "PROMO", "Vendor").otherwise("EPC"), F.col("ne"), F.col("n"))
    return g.select("p_name", "p_type", status.alias("status"))


@query("SELECT p_brand, count(*) AS n_rows, count(DISTINCT p_type) AS n_projects, round(max(p_retailprice), 2) AS most FROM part GROUP BY 1")
def vendor_master_agg(t: Tables) -> DataFrame:
    return L.vendor_summary(t.part, "p_brand", "p_type", "p_retailprice")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'Fixings' WHEN regexp_matches(p_name, 'valve|panel') THEN 'Control' ELSE 'Review Needed' END AS package,
upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' HVAC A/b ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS shown FROM part""")
def package_mapping(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    shown = L.engineering_title(F.concat_ws(" ", words[0], F.lit("hvac A/b"), F.upper(words[1])))
    return t.part.select("p_partkey", L.package_of(F.col("p_name"), (("Fixings", "ring|bolt"), ("Control", "valve|panel"))).alias("package"), shown.alias("shown"))


@query("""WITH d AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS building, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS equipment, CASE WHEN p_size % 5 < 3 THEN 'Brand#1' ELSE '' END AS db, CASE WHEN p_size % 7 < 4 THEN 'PROMO' ELSE '' END AS de FROM part)
SELECT p_partkey, CASE WHEN building = '' AND db <> '' THEN db ELSE building END AS building, CASE WHEN equipment = '' AND de <> '' THEN de ELSE equipment END AS equipment,
  concat_ws(';', CASE WHEN building = '' AND db <> '' THEN 'filled_building' END, CASE WHEN equipment = '' AND de <> '' THEN 'filled_equipment' END) AS actions,
  concat_ws(';', CASE WHEN building <> '' AND db <> '' AND building <> db THEN 'building_conflict' END, CASE WHEN equipment <> '' AND de <> '' AND equipment <> de THEN 'equipment_conflict' END) AS conflicts,
  least(CASE WHEN building = '' AND db <> '' THEN 0.85 ELSE 1 END, CASE WHEN equipment = '' AND de <> '' THEN 0.8 ELSE 1 END, CASE WHEN (building <> '' AND db <> '' AND building <> db) OR (equipment <> '' AND de <> '' AND equipment <> de) THEN 0.35 ELSE 1 END)::DOUBLE AS confidence FROM d""")
def register_cleaner(t: Tables) -> DataFrame:
    s = F.col("p_size")
    rows = t.part.select("p_partkey", "p_size", F.when(s % 2 == 0, F.col("p_brand")).otherwise("").alias("building"), F.when(s % 3 == 0, F.col("p_type")).otherwise("").alias("equipment"))
    return L.clean_register_row(rows, {"building": F.when(s % 5 < 3, "Brand#1").otherwise(""), "equipment": F.when(s % 7 < 4, "PROMO").otherwise("")}).drop("p_size")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#3') ")
def catalog_export_contains(t: Tables) -> DataFrame:
    terms = ("RING", "#3")
    hit = F.contains(F.lower("p_name"), F.lower(F.lit(terms[0]))) | F.contains(F.lower("p_brand"), F.lower(F.lit(terms[1])))
    return t.part.filter(hit).select("p_partkey", "p_name")


@query("""SELECT p_type, max(CASE WHEN r = 1 THEN p_name END) AS doc_1, max(CASE WHEN r = 2 THEN p_name END) AS doc_2, max(CASE WHEN r = 3 THEN p_name END) AS doc_3, string_agg(p_partkey::VARCHAR, '|' ORDER BY r) AS ids
FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY 1""")
def wide_pivot_topn(t: Tables) -> DataFrame:
    top = t.part.withColumn("r", ranked(["p_type"], F.desc("p_retailprice"), F.asc("p_partkey"))).filter("r <= 3")
    from dossier.functions.columns import ordered_values

    wide = [F.max(F.when(F.col("r") == i, F.col("p_name"))).alias(f"doc_{i}") for i in (1, 2, 3)]
    return top.groupBy("p_type").agg(*wide, F.array_join(F.transform(ordered_values("p_partkey", "r"), lambda x: x.cast("string")), "|").alias("ids"))

"""Register wording, scopes and audit joins over parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.vocabulary import alias_pattern
from dossier.operators import registers as G
from dossier.plans.registry import Tables, query
from dossier.plans.wording import TITLED, titled_parts


def _case(pairs, otherwise="''") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE {otherwise} END"


EXTRACT = _case([(f"contains(upper(title), '{w}')", w) for w in G.DELIVERABLE_WORDS])


@query(f"""WITH {TITLED}, d AS (SELECT p_partkey, {EXTRACT} AS found, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'datasheet ' ELSE deliverable END AS value FROM tp)
SELECT p_partkey, found, {_case([(f"upper(trim(value)) = '{k}'", v) for k, v in G.RULE_WORDS.items()], "trim(value)")} AS normal FROM d""")
def deliverable_words(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    value = F.when(k == 0, "").when(k == 1, "datasheet ").otherwise(F.col("deliverable"))
    return titled_parts(t).select("p_partkey", G.extract_deliverable("title").alias("found"), G.normalize_deliverable(value).alias("normal"))


_T = "(' ' || regexp_replace(upper(title), '[^A-Z0-9]+', ' ', 'g') || ' ')"


@query(f"""WITH {TITLED}, e AS (SELECT p_partkey, {_case([(f"contains({_T}, ' {s} ') OR contains({_T}, '{f}')", f) for s, f in G.EQUIPMENT_NAMES.items()])} AS equipment FROM tp)
SELECT p_partkey, equipment, {_case([(f"equipment = '{f}'", s) for s, f in G.EQUIPMENT_NAMES.items()], "equipment")} AS short FROM e""")
def equipment_words(t: Tables) -> DataFrame:
    found = titled_parts(t).select("p_partkey", G.named_equipment("title", G.EQUIPMENT_NAMES).alias("equipment"))
    short = F.create_map(*[F.lit(x) for s, f in G.EQUIPMENT_NAMES.items() for x in (f, s)])[F.col("equipment")]
    return found.withColumn("short", F.coalesce(short, "equipment"))


_RAW = ("gt", " WTP (new)", "Fin Fan", "Silo (old)", "(none)")


@query(f"""WITH {TITLED}, v AS (SELECT p_partkey, title, ['gt', ' WTP (new)', 'Fin Fan', 'Silo (old)', '(none)'][1 + p_partkey % 5] AS raw FROM tp), c AS (SELECT *, trim(regexp_replace(raw, '\\(.*?\\)', '', 'g')) AS cleaned FROM v),
e AS (SELECT p_partkey, {_case([(f"upper(cleaned) = '{k}'", v) for k, v in G.EQUIPMENT_RAW.items()], "CASE WHEN cleaned <> '' THEN cleaned ELSE trim(raw) END")} AS canonical, {_case([(f"contains(upper(title), '{w}')", f) for w, f in G.EQUIPMENT_SCAN])} AS equipment FROM c)
SELECT *, {_case([(f"equipment = '{f}'", s) for f, s in G.EQUIPMENT_SHORT.items()], "equipment")} AS short FROM e""")
def equipment_names(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("p_partkey") % 5 + 1).cast("int"))
    out = titled_parts(t).select("p_partkey", G.normalize_equipment(raw).alias("canonical"), G.equipment_in("title").alias("equipment"))
    return out.withColumn("short", G.equipment_short("equipment"))


def _keys_sql(kind: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(upper(title), '(^|[^A-Z0-9])({'|'.join(a.replace('+', chr(92) + '+') for a in al)})([^A-Z0-9]|$)') THEN '{k}' END" for k, al in G.INTENT[kind]) + "], lambda x: x IS NOT NULL))"


@query(f"WITH {TITLED} SELECT p_partkey, " + ", ".join(f"{_keys_sql(k)} AS {k}" for k in G.INTENT) + " FROM tp")
def requirement_intent(t: Tables) -> DataFrame:
    assert alias_pattern(("A",))
    return titled_parts(t).select("p_partkey", G.requirement_intent("title").alias("i")).select("p_partkey", "i.*")


_FAM = ("diagram", "plan", "datasheet", "list")


@query("""WITH x AS (SELECT p_partkey, ['diagram', 'plan', 'datasheet', 'list'][1 + p_partkey % 4] AS fam, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS eq, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS sy, CASE WHEN p_size % 5 = 0 THEN p_type ELSE '' END AS bu FROM part),
o AS (SELECT p_partkey, CASE fam WHEN 'diagram' THEN [sy, eq, 'T', bu] WHEN 'plan' THEN [bu, eq, sy, 'T'] WHEN 'datasheet' THEN [eq, sy, 'T', bu] ELSE [eq, sy, bu, 'T'] END AS v, CASE fam WHEN 'diagram' THEN ['system', 'equipment', 'title', 'building'] WHEN 'plan' THEN ['building', 'equipment', 'system', 'title'] WHEN 'datasheet' THEN ['equipment', 'system', 'title', 'building'] ELSE ['equipment', 'system', 'building', 'title'] END AS n FROM x),
i AS (SELECT *, CASE WHEN v[1] <> '' THEN 1 WHEN v[2] <> '' THEN 2 WHEN v[3] <> '' THEN 3 ELSE 4 END AS k FROM o) SELECT p_partkey, v[k] AS text, n[k] AS source, 'layout for ' || v[k] AS rule_query FROM i""")
def query_scope_resolution(t: Tables) -> DataFrame:
    s = F.col("p_size")
    family = F.element_at(F.array(*[F.lit(x) for x in _FAM]), (F.col("p_partkey") % 4 + 1).cast("int"))
    scope = G.query_scope(family, F.when(s % 2 == 0, F.col("p_name")), F.when(s % 3 == 0, F.col("p_brand")), F.when(s % 5 == 0, F.col("p_type")), F.lit("T"))
    out = t.part.select("p_partkey", scope.alias("s"))
    return out.select("p_partkey", "s.text", "s.source", G.rule_query(F.lit("layout"), "s.text").alias("rule_query"))


@query("SELECT p_partkey, p_name || ' view' AS title, CASE WHEN p_size % 3 = 0 THEN CASE WHEN regexp_matches(upper(p_name), 'RING|BOLT') THEN 'Vendor: Fixings' WHEN regexp_matches(upper(p_name), 'VALVE') THEN 'Vendor: Control' END WHEN p_size % 3 = 1 THEN 'EPC' END AS grp FROM part")
def qualifier_and_group(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Block #2 "), F.col("p_name"), F.lit(" for Unit 12 Alpha view -"))
    scope = F.when(F.col("p_size") % 3 == 0, "Vendor").when(F.col("p_size") % 3 == 1, "EPC").otherwise("Other")
    return t.part.select("p_partkey", G.strip_qualifiers(noisy, ["Alpha"]).alias("title"), G.group_of(scope, "p_name", (("Fixings", "RING|BOLT"), ("Control", "VALVE"))).alias("grp"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(upper(p_name), '(^|[^A-Z0-9])SMALL RING([^A-Z0-9]|$)') THEN 'seal' WHEN regexp_matches(upper(p_name), '(^|[^A-Z0-9])RING([^A-Z0-9]|$)') THEN 'ring' ELSE 'General' END AS value FROM part")
def allowed_value_match(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", G.allowed_value("p_name", (("ring", "ring"), ("small ring", "seal")), "General").alias("value"))


@query("""WITH c AS (SELECT replace(lower(p_brand), '#', '_') || '|' || p_size AS k, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 2 = 0)
SELECT a.p_partkey, c.p_partkey AS matched_doc_id FROM part a LEFT JOIN c ON c.k = replace(lower(a.p_brand), '#', '_') || '|' || a.p_size AND c.r = 1 WHERE a.p_partkey % 2 = 1""")
def matched_doc_ids(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    known = rows.filter("p_partkey % 2 = 0").withColumns({"doc_id": F.col("p_partkey"), "position": F.col("p_partkey")})
    return G.resolve_doc_ids(rows.filter("p_partkey % 2 = 1"), known, ["p_brand", "p_size"]).select("p_partkey", "matched_doc_id")


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'F' END AS es, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS ep FROM orders WHERE o_orderkey % 3 = 0), h AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0)
SELECT g.o_orderkey, h.o_orderkey IS NOT NULL AS found, es = '' OR coalesce(es = h.o_orderstatus, false) AS o_orderstatus_agrees, ep = '' OR coalesce(ep = h.o_orderpriority, false) AS o_orderpriority_agrees FROM g LEFT JOIN h USING (o_orderkey)""")
def gold_label_join(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    gold = t.orders.filter(k % 3 == 0).select("o_orderkey", F.when(k % 5 == 0, "").otherwise("F").alias("expected_o_orderstatus"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("expected_o_orderpriority"))
    return G.gold_agreement(gold, t.orders.filter(k % 7 != 0), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, o_custkey, round(a.v, 6) AS text, round(b.v, 6) AS structured, round(c.v, 6) AS hybrid FROM (SELECT o_orderkey, o_custkey, o_totalprice AS v FROM orders) a JOIN (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 2 = 0) b USING (o_orderkey, o_custkey) JOIN (SELECT o_orderkey, o_custkey, o_totalprice * 3 AS v FROM orders WHERE o_orderkey % 3 = 0) c USING (o_orderkey, o_custkey)")
def three_run_comparison(t: Tables) -> DataFrame:
    run = lambda n: t.orders.filter(F.col("o_orderkey") % n == 0).select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * n, 6).alias("v"))
    return G.compare_runs({"text": run(1), "structured": run(2), "hybrid": run(3)}, ["o_orderkey", "o_custkey"], "v")


@query("SELECT c_custkey, coalesce(s, 'False') AS relevant, s IS NULL AS missing FROM customer LEFT JOIN (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_custkey % 4 > 0) USING (c_custkey)")
def answers_by_id(t: Tables) -> DataFrame:
    answers = t.customer.filter("c_custkey % 4 > 0").select("c_custkey", F.col("c_mktsegment").alias("relevant"))
    return G.answers_by_id(t.customer.select("c_custkey"), answers, "c_custkey", {"relevant": "False"})


@query("""WITH r AS (SELECT p_name, p_brand, p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS pr FROM part), b AS (SELECT p_name, string_agg(p_brand, '; ' ORDER BY p) AS p_brand FROM (SELECT p_name, p_brand, min(p_partkey) AS p FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT p_name, evidence AS p_type, p_brand FROM (SELECT p_name, arg_min(p_type, (pr, p_partkey)) AS evidence FROM r GROUP BY 1) JOIN b USING (p_name)""")
def evidence_priority(t: Tables) -> DataFrame:
    return G.consolidate_by_priority(t.part, ["p_name"], {"PROMO": 0, "ECONOMY": 1}, "p_type", "p_partkey", {"p_brand": "; "})


@query("SELECT o_orderkey, l_partkey AS doc_id, l_partkey IS NOT NULL AS has_match FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.08) ON l_orderkey = o_orderkey")
def scoped_truth_rows(t: Tables) -> DataFrame:
    positives = t.lineitem.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("doc_id")).distinct()
    return G.scoped_truth(t.orders, positives, ["o_orderkey"])


@query("""WITH l AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 4 = 0 THEN 'partial' WHEN o_orderkey % 5 = 0 THEN 'no' WHEN o_orderkey % 7 = 0 THEN 'yes' END AS x FROM orders)
SELECT o_orderpriority, count(x) AS labelled, count(*) FILTER (x = 'yes') AS yes, count(*) FILTER (x = 'partial') AS partial, count(*) AS n, CASE WHEN count(x) > 0 THEN round(count(*) FILTER (x = 'yes') / count(x), 6) END AS accuracy FROM l GROUP BY 1""")
def label_accuracy(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    human = F.when(k % 3 == 0, "Yes").when(k % 4 == 0, "partial").when(k % 5 == 0, " no ").otherwise("")
    return G.label_accuracy(t.orders.select("o_orderpriority", human.alias("human_label"), F.when(k % 7 == 0, "yes").alias("model_label")), "o_orderpriority")


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'promotable' ELSE 'control' END AS tag FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY md5('11:' || o_orderkey), o_orderkey) AS r FROM g) SELECT o_orderkey, tag, '' AS human_label, '' AS human_note FROM r WHERE r <= 50""")
def review_sample(t: Tables) -> DataFrame:
    """Sampling a bounded number of rows of each tag is the feature."""
    rows = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "skip").otherwise("generated").alias("date_status"))
    return G.review_sample(rows, F.col("o_totalprice") > 200000, "o_orderkey", 50, 11).select("o_orderkey", "tag", "human_label", "human_note")


@query("SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_type = 'PROMO'")
def shared_sections(t: Tables) -> DataFrame:
    return t.part.filter("p_size < 10").select("p_brand").intersect(t.part.filter("p_type = 'PROMO'").select("p_brand"))

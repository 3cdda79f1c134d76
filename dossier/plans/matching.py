"""Rule and activity matching, candidate alignment and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import vocabulary as V
from dossier.operators import matching as M
from dossier.plans.registry import Tables, query

#: (rule_id, keyword, priority, sub_type, family, scope) of a small rule table.
RULES = (
    (1, "small ring layout", 1, "FA", "drawing", "acc"), (2, "ring data sheet", 2, "FA", "datasheet", ""), (3, "large widget specification", 1, "FI", "specification", "hrsg"),
    (4, "bolt", 3, "SKIP", "", ""), (5, "blue panel diagram for promo", 2, "FA", "diagram", "gtg"), (6, "system drawing", 3, "FA", "drawing", ""), (7, "red valve", 1, "FA", "specification", ""), (8, "green gear plan", 2, "FC", "plan", "stg"),
)


def rules(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([*RULES], "rule_id int, keyword string, priority int, sub_type string, family string, scope string")
    return df.withColumn("tokens", T.rule_tokens("keyword")).withColumn("scopes", F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(F.array("scope")))


RULES_SQL = "ru AS (SELECT *, list_distinct(list_filter(regexp_extract_all(keyword, '[a-z0-9&]+'), lambda t: length(t) >= 2)) AS rt FROM (VALUES " + ", ".join(str(r) for r in RULES) + ") v(rule_id, keyword, priority, sub_type, family, scope))"
PARTS_SQL = "pq AS (SELECT p_partkey AS query_id, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9&]+'), lambda t: length(t) >= 2)) AS qt FROM part)"
STOP_SQL = "[" + ", ".join(f"'{x}'" for x in M.STOP_TOKENS) + "]"
CAND_SQL = f"""{RULES_SQL}, {PARTS_SQL},
cd AS (SELECT query_id, rule_id, priority, sub_type, family, scope, qt, rt, len(list_intersect(rt, qt)) / greatest(len(rt), 3) AS token_score FROM pq, ru WHERE len(list_intersect(list_filter(qt, lambda x: NOT list_contains({STOP_SQL}, x)), rt)) > 0)"""


def _queries(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("query_id"), T.rule_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"), "p_type", "p_size")


@query(f"WITH {CAND_SQL} SELECT query_id, rule_id, round(token_score, 6) AS token_score FROM cd")
def token_recall_join(t: Tables) -> DataFrame:
    return M.rule_candidates(_queries(t), rules(t)).select("query_id", "rule_id", F.round("token_score", 6).alias("token_score"))


SCORED_SQL = CAND_SQL + """,
sc AS (SELECT *, (token_score * 0.7 + (query_id % 10) / 10.0 * 0.3) * CASE priority WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.6 END AS final_score,
  CASE WHEN query_id % 4 = 0 THEN 'specification' WHEN query_id % 4 = 1 THEN 'drawing' ELSE '' END AS qf, CASE WHEN (query_id + rule_id) % 6 = 0 THEN 'scope_mismatch' ELSE '' END AS guard FROM cd),
us AS (SELECT *, guard = '' AND token_score > 0 AND final_score >= 0.2 AS ok FROM sc),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, (qf = 'specification' AND family = 'specification') DESC, (qf = 'specification' AND family = 'specification' AND rule_id % 2 = 1) DESC, (qf = 'specification' AND sub_type <> 'SKIP') DESC, round(final_score, 9) DESC, priority, rule_id) AS r FROM us WHERE ok OR guard <> '')"""


def _scored(t: Tables) -> DataFrame:
    pairs = M.rule_candidates(_queries(t), rules(t)).drop("priority").join(rules(t).drop("tokens"), "rule_id")
    semantic = (F.col("query_id") % 10) / 10.0
    kind = F.when(F.col("query_id") % 4 == 0, "specification").when(F.col("query_id") % 4 == 1, "drawing").otherwise("")
    return pairs.select(
        "query_id", "rule_id", "priority", "token_score", F.round(M.hybrid_score(F.col("token_score"), semantic, F.col("priority")), 9).alias("final_score"), "sub_type", F.col("family").alias("rule_family"),
        kind.alias("query_family"), (F.col("rule_id") % 2 == 1).alias("subtype_ok"), F.when((F.col("query_id") + F.col("rule_id")) % 6 == 0, "scope_mismatch").otherwise("").alias("guard"),
    )


@query(f"WITH {SCORED_SQL} SELECT query_id, CASE WHEN ok THEN rule_id END AS rule_id, round(final_score, 6) AS final_score, guard FROM br WHERE r = 1")
def rule_best_match(t: Tables) -> DataFrame:
    return M.best_rule(_scored(t)).select("query_id", "rule_id", F.round("final_score", 6).alias("final_score"), "guard")


@query(f"""WITH {SCORED_SQL}, p AS (SELECT query_id, CASE WHEN ok THEN rule_id END AS rule_id, round(final_score, 9) AS final_score, CASE query_id % 3 WHEN 0 THEN 'rule_generic' WHEN 1 THEN 'match' ELSE 'query_unscoped' END AS scope_status FROM br WHERE r = 1),
tt AS (SELECT query_id, rule_id + 100 AS rule_id, round(final_score * 1.2, 9) AS final_score FROM p WHERE query_id % 2 = 0)
SELECT p.query_id, CASE WHEN u THEN t.rule_id ELSE p.rule_id END AS rule_id, round(CASE WHEN u THEN t.final_score ELSE p.final_score END, 6) AS final_score, CASE WHEN u THEN 'title' ELSE 'primary' END AS query_source
FROM (SELECT p.*, coalesce((p.rule_id IS NULL OR (p.scope_status IN ('rule_generic', 'query_unscoped') AND p.final_score < 0.7)) AND t.rule_id IS NOT NULL AND (p.rule_id IS NULL OR t.final_score > p.final_score), false) AS u FROM p LEFT JOIN tt t USING (query_id)) p LEFT JOIN tt t USING (query_id)""")
def title_rescue(t: Tables) -> DataFrame:
    scope = F.when(F.col("query_id") % 3 == 0, "rule_generic").when(F.col("query_id") % 3 == 1, "match").otherwise("query_unscoped")
    primary = M.best_rule(_scored(t)).select("query_id", "rule_id", "final_score", scope.alias("scope_status"))
    by_title = primary.filter("query_id % 2 = 0").select("query_id", (F.col("rule_id") + 100).alias("rule_id"), F.round(F.col("final_score") * 1.2, 9).alias("final_score"), "scope_status")
    return M.title_rescue(primary, by_title).select("query_id", "rule_id", F.round("final_score", 6).alias("final_score"), "query_source")


_FAMS = ("specification", "diagram", "drawing", "curve", "list", "")
_SUBS = ("technical_specification", "diagram", "layout_drawing", "performance_curve", "io_list", "specification", "painting_specification")
_SCOPES = ("fire_protection", "drainage", "acc", "")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _pick_sql(values, key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({key}) % {len(values)}]"


_COMPAT = "((a = b) OR (a NOT IN {s} AND b NOT IN {s} AND (a, b) IN ({p})))".format(s="(" + ", ".join(f"'{x}'" for x in M.STRICT_FAMILIES) + ")", p=", ".join(f"('{x}', '{y}')" for x, y in M.COMPATIBLE_FAMILIES))
_STRICT = "(" + ", ".join(f"'{x}'" for x in M.STRICT_FAMILIES) + ")"
_GEN = "(" + ", ".join(f"'{x}'" for x in M.GENERIC_SUBTYPES) + ")"
PAIR_SQL = f"""gp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_pick_sql(_FAMS, 'l_orderkey')} AS a, {_pick_sql(_FAMS, 'l_partkey')} AS b, {_pick_sql(_SUBS, 'l_orderkey')} AS x, {_pick_sql(_SUBS, 'l_partkey')} AS y,
  list_filter([{_pick_sql(_SCOPES, 'l_suppkey')}, {_pick_sql(_SCOPES, 'l_orderkey')}], lambda v: v <> '') AS qs, list_filter([{_pick_sql(_SCOPES, 'l_partkey')}], lambda v: v <> '') AS rs, ['t' || (l_orderkey % 5)] AS qt, CASE WHEN l_partkey % 3 = 0 THEN [] ELSE ['t' || (l_partkey % 5)] END AS rt FROM lineitem),
gs AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 'unknown' WHEN x = y THEN 'match' WHEN a <> b THEN 'not_applicable' WHEN x IN {_GEN} AND y IN {_GEN} THEN 'compatible' ELSE 'mismatch' END AS ss,
  list_intersect(qs, ['fire_protection', 'drainage', 'cooling_tower']) AS qe, list_intersect(rs, ['fire_protection', 'drainage', 'cooling_tower']) AS re FROM gp)"""


def _pairs(t: Tables) -> DataFrame:
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    named = lambda *vs: F.filter(F.array(*vs), lambda v: v != "")
    none = F.array().cast("array<string>")
    q = F.struct(_pick(_FAMS, o).alias("family"), _pick(_SUBS, o).alias("subtype"), named(_pick(_SCOPES, s), _pick(_SCOPES, o)).alias("scope"), F.array(F.concat(F.lit("t"), o % 5)).alias("tokens"))
    r = F.struct(_pick(_FAMS, p).alias("family"), _pick(_SUBS, p).alias("subtype"), named(_pick(_SCOPES, p)).alias("scope"), F.when(p % 3 == 0, none).otherwise(F.array(F.concat(F.lit("t"), p % 5))).alias("tokens"), (s % 2 == 0).alias("specific"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), r.alias("r"))


@query(f"""WITH {PAIR_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x = 'painting_specification' THEN 'blocked_deliverable_family' WHEN len(qs) > 0 AND len(rs) > 0 AND len(list_intersect(qs, rs)) = 0 THEN 'scope_mismatch'
WHEN len(qs) > 0 AND len(qe) > 0 AND len(re) > 0 AND len(list_intersect(qe, re)) = 0 THEN 'system_scope_conflict' WHEN ss = 'mismatch' THEN 'deliverable_subtype_mismatch' WHEN a IN {_STRICT} AND b = '' THEN 'missing_rule_family'
WHEN a <> '' AND b <> '' AND NOT {_COMPAT} THEN 'deliverable_family_mismatch' WHEN len(qs) > 0 AND a IN {_STRICT} AND a = b AND len(rs) = 0 AND l_suppkey % 2 = 0 THEN 'implicit_scope_mismatch'
WHEN a = b AND x = y AND len(rt) > 0 AND len(list_intersect(qt, rt)) = 0 AND (x NOT IN {_GEN} OR a IN ('diagram', 'specification', 'list', 'report', 'drawing')) THEN 'object_token_mismatch' ELSE '' END AS guard FROM gs""")
def rule_guard_reasons(t: Tables) -> DataFrame:
    return _pairs(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.guard_reason(F.col("q"), F.col("r")).alias("guard"))


@query(f"""WITH {PAIR_SQL}, st AS (SELECT *, CASE WHEN a = '' AND b = '' THEN 'unknown' WHEN a = '' THEN 'missing_query_family' WHEN b = '' THEN 'missing_rule_family' WHEN a = b THEN 'match' WHEN {_COMPAT} THEN 'compatible' ELSE 'mismatch' END AS family_status,
CASE WHEN len(qs) = 0 THEN 'query_unscoped' WHEN len(rs) = 0 THEN 'rule_generic' WHEN len(list_intersect(qs, rs)) > 0 THEN 'match' ELSE 'mismatch' END AS scope_status FROM gs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, family_status, ss AS subtype_status, scope_status, CASE WHEN scope_status = 'rule_generic' THEN CASE WHEN family_status <> 'match' OR ss NOT IN ('match', 'not_applicable', '') THEN 'weak' WHEN l_suppkey % 3 > 0 THEN 'ambiguous' ELSE 'safe' END END AS bucket FROM st""")
def generic_bucket(t: Tables) -> DataFrame:
    q, r = F.col("q"), F.col("r")
    out = _pairs(t).withColumns({"family_status": M.family_status(q["family"], r["family"]), "subtype_status": M.subtype_status(q["family"], q["subtype"], r["family"], r["subtype"]), "scope_status": M.rule_scope_status(q["scope"], r["scope"]), "n_competing": F.col("l_suppkey") % 3})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "family_status", "subtype_status", "scope_status", M.generic_bucket(out).alias("bucket"))


MAPPING = (("ECONOMY", "Brand#1", "design|civil"), ("ECONOMY", "*", "design"), ("STANDARD", "Brand#2", "procurement"), ("PROMO", "*", "delivery"), ("other", "*", "any"))


@query("""WITH m AS (SELECT * FROM (VALUES """ + ", ".join(str(m) for m in MAPPING) + """) v(family, scope, phases)),
q AS (SELECT p_partkey, [p_type, CASE WHEN p_size > 25 THEN 'other' ELSE 'none' END] AS ks, [p_brand, '*'] AS ss FROM part),
c AS (SELECT p_partkey, i, j, ks[i] AS family, ss[j] AS scope FROM q, range(1, 3) a(i), range(1, 3) b(j)),
h AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) AS r FROM c JOIN m USING (family, scope))
SELECT p_partkey AS query_id, h.family, h.scope, h.phases FROM part LEFT JOIN (SELECT * FROM h WHERE r = 1) h USING (p_partkey)""")
def domain_mapping_fallback(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([*MAPPING], "family string, scope string, phases string")
    asked = t.part.select(F.col("p_partkey").alias("query_id"), F.array("p_type", F.when(F.col("p_size") > 25, "other").otherwise("none")).alias("mapping_keys"), F.array("p_brand").alias("scopes"))
    return M.mapped(asked, mapping).select("query_id", "family", "scope", "phases")


@query("""WITH q AS (SELECT c_custkey, c_nationkey AS s, unnest([c_mktsegment, 'ANY']) AS p FROM customer), a AS (SELECT s_suppkey, s_nationkey AS s, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'ANY' ELSE 'BUILDING' END, 'MACHINERY']) AS p FROM supplier)
SELECT DISTINCT c_custkey AS query_id, s_suppkey AS activity_id FROM q JOIN a USING (s, p)""")
def cell_join(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_custkey").alias("query_id"), F.array("c_nationkey").alias("systems"), F.array("c_mktsegment", F.lit("ANY")).alias("phases"))
    right = t.supplier.select(F.col("s_suppkey").alias("activity_id"), F.array("s_nationkey").alias("systems"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "ANY").otherwise("BUILDING"), F.lit("MACHINERY")).alias("phases"))
    return M.cells(left, right)


@query("""WITH r AS (SELECT p_partkey AS rule_id, p_type AS subtype, [p_brand] AS scope, p_size AS timeline, p_partkey % 50 = 0 AS g FROM part)
SELECT a.rule_id, b.rule_id AS other_id FROM r a JOIN r b USING (subtype) WHERE a.g AND NOT b.g AND len(list_intersect(a.scope, b.scope)) > 0 AND a.timeline IS DISTINCT FROM b.timeline""")
def competing_rules(t: Tables) -> DataFrame:
    return M.competing_rules(t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("subtype"), F.array("p_brand").alias("scope"), F.col("p_size").alias("timeline"), (F.col("p_partkey") % 50 == 0).alias("generic")))


_WANTS = {"wants_equipment": "l_orderkey % 3 > 0", "equipment_hit": "l_partkey % 2 = 0", "has_equipment": "l_suppkey % 2 = 0", "wants_system": "l_orderkey % 2 > 0", "system_hit": "l_partkey % 3 = 0", "wants_deliverable": "l_orderkey % 5 > 0", "subtype_hit": "l_partkey % 7 = 0", "family_hit": "l_partkey % 5 = 0", "term_hit": "l_suppkey % 3 = 0", "has_family": "l_suppkey % 5 > 0", "wants_constraint": "l_orderkey % 30 > 0", "constraint_hit": "l_linenumber % 2 = 0"}
ALIGN_SQL = "wa AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, " + ", ".join(f"({e}) AS {k}" for k, e in _WANTS.items()) + """ FROM lineitem),
al AS (SELECT *, round(CASE WHEN NOT wants_equipment THEN 0 WHEN equipment_hit THEN 0.12 WHEN has_equipment THEN -0.16 ELSE -0.04 END + CASE WHEN wants_system AND system_hit THEN 0.04 ELSE 0 END
  + CASE WHEN NOT wants_deliverable THEN 0 WHEN subtype_hit THEN CASE WHEN term_hit THEN 0.22 ELSE 0.18 END WHEN family_hit THEN CASE WHEN term_hit THEN 0.11 ELSE 0.08 END WHEN term_hit THEN 0.05 WHEN has_family THEN -0.18 ELSE -0.06 END
  + CASE WHEN wants_constraint AND constraint_hit THEN 0.03 ELSE 0 END, 4)::DOUBLE AS s, (wants_equipment AND NOT equipment_hit AND has_equipment) OR (wants_deliverable AND NOT subtype_hit AND NOT family_hit AND NOT term_hit AND has_family) AS bad,
  wants_equipment OR wants_system OR wants_deliverable OR wants_constraint AS asks FROM wa),
ad AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN asks THEN s ELSE 0.0 END::DOUBLE AS score, CASE WHEN NOT asks THEN 'unknown' WHEN bad AND s <= -0.10 THEN 'mismatch' WHEN NOT bad AND s >= 0.18 THEN 'aligned' WHEN s >= 0.02 THEN 'weak' WHEN bad THEN 'mismatch' ELSE 'weak' END AS status FROM al)"""


def _aligned(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *[F.expr(e).alias(k) for k, e in _WANTS.items()])
    return df.withColumn("a", M.intent_alignment(df)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "a.score", "a.status")


@query(f"WITH {ALIGN_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, status FROM ad")
def intent_alignment(t: Tables) -> DataFrame:
    return _aligned(t).drop("l_quantity")


@query(f"""WITH {ALIGN_SQL}, td AS (SELECT l_orderkey AS chunk_id, l_partkey * 1000 + l_suppkey AS doc_id, max(status) AS status, max(l_quantity) / 50 AS q, min(l_linenumber) AS rank FROM ad GROUP BY 1, 2),
t1 AS (SELECT *, round(q + 0.5, 6) AS sel, CASE status WHEN 'aligned' THEN 0 WHEN 'weak' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END AS tier FROM td),
t2 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, tier ORDER BY sel DESC, rank, doc_id) AS n FROM t1), t3 AS (SELECT *, tier < 2 OR (tier = 2 AND n = 1) AS i FROM t2),
t4 AS (SELECT *, sum(i::INT) OVER (PARTITION BY chunk_id ORDER BY tier, n ROWS UNBOUNDED PRECEDING) AS place FROM t3), t5 AS (SELECT *, i AND place <= 2 AS tk FROM t4), t6 AS (SELECT *, bool_or(tk) OVER (PARTITION BY chunk_id) AS got FROM t5)
SELECT chunk_id, doc_id, CASE WHEN tk THEN 'top_2_' || status WHEN NOT got AND tier = 3 AND n = 1 THEN 'top_2_mismatch_fallback' WHEN q >= 0.82 AND tier < 2 THEN 'high_score>=0.82' ELSE 'outside_top_k' END AS reason, tk OR (NOT got AND tier = 3 AND n = 1) OR (q >= 0.82 AND tier < 2) AS selected FROM t6""")
def tiered_selection(t: Tables) -> DataFrame:
    rows = _aligned(t).groupBy(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("doc_id")).agg(F.max("status").alias("status"), (F.max("l_quantity") / 50).alias("score"), F.min("l_linenumber").alias("rank"))
    return M.tiered_selection(rows.withColumn("selection_score", F.round(F.col("score") + 0.5, 6)), most=2).select("chunk_id", "doc_id", "reason", "selected")


@query("""WITH c AS (SELECT l_orderkey AS query_id, l_partkey * 8 + l_linenumber AS doc_id, CASE l_returnflag WHEN 'R' THEN 'match' WHEN 'A' THEN 'activity_unscoped' ELSE 'mismatch' END AS scope_status, CASE l_linestatus WHEN 'F' THEN 'match' ELSE 'compatible' END AS ph, l_quantity, l_suppkey, l_partkey FROM lineitem),
a AS (SELECT *, l_quantity / 1500 AS rrf FROM c), b AS (SELECT *, round(rrf * CASE ph WHEN 'match' THEN 1.0 ELSE 0.75 END * CASE scope_status WHEN 'match' THEN 1.0 WHEN 'activity_unscoped' THEN 0.75 ELSE 0.25 END * CASE WHEN l_partkey % 5 = 0 THEN 0.8 ELSE 1.0 END * CASE WHEN l_suppkey % 7 = 0 AND scope_status <> 'match' THEN 0.5 ELSE 1.0 END, 9) AS adjusted FROM a)
SELECT query_id, doc_id, adjusted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (scope_status = 'match') DESC, adjusted DESC, round(rrf, 9) DESC, doc_id) AS r FROM (SELECT query_id, doc_id, scope_status, max(adjusted) AS adjusted, max(rrf) AS rrf FROM b GROUP BY 1, 2, 3)) WHERE r = 1""")
def best_activity(t: Tables) -> DataFrame:
    scope = F.when(F.col("l_returnflag") == "R", "match").when(F.col("l_returnflag") == "A", "activity_unscoped").otherwise("mismatch")
    df = t.lineitem.select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("doc_id"), scope.alias("scope_status"), F.when(F.col("l_linestatus") == "F", "match").otherwise("compatible").alias("phase"), (F.col("l_quantity") / 1500).alias("rrf"), "l_partkey", "l_suppkey")
    df = df.withColumn("adjusted", F.round(V.adjusted_score("rrf", "phase", "scope_status", F.col("l_partkey") % 5 == 0, F.col("l_suppkey") % 7 == 0), 9))
    df = df.groupBy("query_id", "doc_id", "scope_status").agg(F.max("adjusted").alias("adjusted"), F.round(F.max("rrf"), 9).alias("rrf")).withColumn("rank", F.col("doc_id"))
    return M.best_activity(df).select("query_id", "doc_id", "adjusted")

"""Formulas, anchors, windows and confidence over orders and line items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import dates as D
from dossier.operators import quality as Q
from dossier.plans.registry import Tables, query

FORMULAS = (
    "start+4W<=FA<=start+6W", "start-4M-2M <= FA =< start-4M", "start+8W<=FA<=FC<=start+20W", "start-3M<=FC<=start-1M", "start<=FA<=start+2M", "-",
    "finish+0.5W<=FA<finish+1.5M", "start+2W<=FA<=FC<=start+12W\nsecond line", "soon", "start-1Y<=FA<=start-10D",
)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


_T = "[+-][0-9]+(?:\\.[0-9]+)?[DWMYdwmy]m?"
_DAYS = """list_sum(list_transform(regexp_extract_all({x}, '[+-][0-9]+(?:\\.[0-9]+)?[DWMYdwmy]m?'), lambda t: (CASE WHEN t[1] = '-' THEN -1 ELSE 1 END) *
  round_even(regexp_extract(t, '[0-9]+(\\.[0-9]+)?')::DOUBLE * CASE upper(regexp_extract(t, '([DWMYdwmy])m?$', 1)) WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'M' THEN 30 ELSE 365 END, 0)::INT))"""


def _g(pattern: str, g: int) -> str:
    return f"regexp_extract(f, '{pattern}', {g})"


_JOINT = f"(?i)^(start|finish)((?:{_T})+)<=FA<=FC<=(start|finish)((?:{_T})+)$"
_FC = f"(?i)^(start|finish)((?:{_T})+)<=FC<=(start|finish)((?:{_T})+)$"
_FA = f"(?i)^(start|finish)((?:{_T})+)<=FA<=?(start|finish)((?:{_T})+)$"
_OPEN = f"(?i)^(start|finish)<=FA<=(start|finish)((?:{_T})+)$"
PARSED = f"""fo AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderpriority AS pri, {_list(FORMULAS)}[1 + o_orderkey % {len(FORMULAS)}] AS raw FROM orders),
fm AS (SELECT *, replace(regexp_replace(split_part(raw, chr(10), 1), '\\s+', '', 'g'), '=<', '<=') AS f FROM fo),
vt AS (SELECT *, regexp_matches(f, '{_JOINT}') AS mj, regexp_matches(f, '{_FC}') AS mc, regexp_matches(f, '{_FA}') AS ma, regexp_matches(f, '{_OPEN}') AS mo FROM fm),
vp AS (SELECT o_orderkey, d, pri, raw, (mj OR mc OR ma OR mo) AS valid, CASE WHEN mj OR mc OR ma OR mo THEN lower(regexp_extract(f, '^(?i)(start|finish)', 1)) ELSE 'start' END AS anchor,
  CASE WHEN mj THEN {_DAYS.format(x=_g(_JOINT, 2))} WHEN ma THEN {_DAYS.format(x=_g(_FA, 2))} WHEN mo THEN 0 END::INT AS fa_lo,
  CASE WHEN mj THEN {_DAYS.format(x=_g(_JOINT, 4))} WHEN ma THEN {_DAYS.format(x=_g(_FA, 4))} WHEN mo THEN {_DAYS.format(x=_g(_OPEN, 3))} END::INT AS fa_hi,
  CASE WHEN mj THEN {_DAYS.format(x=_g(_JOINT, 2))} WHEN mc THEN {_DAYS.format(x=_g(_FC, 2))} END::INT AS fc_lo,
  CASE WHEN mj THEN {_DAYS.format(x=_g(_JOINT, 4))} WHEN mc THEN {_DAYS.format(x=_g(_FC, 4))} END::INT AS fc_hi FROM vt)"""


def formulas(t: Tables) -> DataFrame:
    """(o_orderkey, raw, parsed, anchor_date, sub_type): each order has a formula; its date is the anchor."""
    raw = F.element_at(F.array(*[F.lit(x) for x in FORMULAS]), (F.col("o_orderkey") % len(FORMULAS) + 1).cast("int"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "SKIP").when(F.col("o_orderpriority") == "2-HIGH", "FI").otherwise("FA")
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("anchor_date"), kind.alias("sub_type"), raw.alias("raw"), D.parse_validation_time(raw).alias("parsed"))


@query(f"WITH {PARSED} SELECT o_orderkey, valid, anchor, fa_lo, fa_hi, fc_lo, fc_hi FROM vp")
def vt_parse(t: Tables) -> DataFrame:
    return formulas(t).select("o_orderkey", "parsed.*")


@query(f"""WITH {PARSED} SELECT o_orderkey, CASE WHEN NOT valid THEN 'No rule (' || trim(raw) || ')' ELSE concat_ws('  |  ',
  CASE WHEN fa_lo IS NOT NULL THEN 'FA ∈ [' || anchor || printf('%+d', fa_lo) || 'd, ' || anchor || printf('%+d', fa_hi) || 'd]' END,
  CASE WHEN fc_lo IS NOT NULL THEN 'FC ∈ [' || anchor || printf('%+d', fc_lo) || 'd, ' || anchor || printf('%+d', fc_hi) || 'd]' END) END AS words FROM vp""")
def vt_describe(t: Tables) -> DataFrame:
    return formulas(t).select("o_orderkey", D.describe_validation_time(F.col("parsed"), "raw").alias("words"))


RANGES = PARSED + """,
k AS (SELECT *, CASE pri WHEN '1-URGENT' THEN 'SKIP' WHEN '2-HIGH' THEN 'FI' ELSE 'FA' END AS sub FROM vp),
r1 AS (SELECT *, CASE WHEN go THEN d + fa_lo END AS ae, CASE WHEN go THEN d + fa_hi END AS al, CASE WHEN go THEN d + fc_lo END AS ce, CASE WHEN go THEN d + fc_hi END AS cl FROM (SELECT *, valid AND sub <> 'SKIP' AS go FROM k)),
r2 AS (SELECT *, ae + floor((al - ae) / 2.0)::INT AS ar, ce + floor((cl - ce) / 2.0)::INT AS cr FROM r1),
r3 AS (SELECT o_orderkey, sub, CASE WHEN cr IS NULL AND ar IS NOT NULL THEN ar + 45 ELSE ce END AS ce, CASE WHEN cr IS NULL AND ar IS NOT NULL THEN ar + 75 ELSE cl END AS cl, CASE WHEN cr IS NULL AND ar IS NOT NULL THEN ar + 60 ELSE cr END AS cr,
  CASE WHEN cr IS NOT NULL AND ar IS NULL AND sub = 'FA' THEN cr - 75 ELSE ae END AS ae, CASE WHEN cr IS NOT NULL AND ar IS NULL AND sub = 'FA' THEN cr - 45 ELSE al END AS al, CASE WHEN cr IS NOT NULL AND ar IS NULL AND sub = 'FA' THEN cr - 60 ELSE ar END AS ar FROM r2),
r4 AS (SELECT *, coalesce(greatest(0, (ar + 21) - ce), 0)::INT AS gap FROM r3),
rg AS (SELECT o_orderkey, sub, ae AS fa_earliest, ar AS fa_recommended, al AS fa_latest, ce + gap AS fc_earliest, cr + gap AS fc_recommended, cl + gap AS fc_latest FROM r4)
"""


@query(f"WITH {RANGES} SELECT o_orderkey, fa_earliest, fa_recommended, fa_latest, fc_earliest, fc_recommended, fc_latest FROM rg")
def date_range(t: Tables) -> DataFrame:
    return D.with_date_range(formulas(t), "parsed", "anchor_date", "sub_type").select("o_orderkey", *D.RANGE)


FLOOR = dt.date(1997, 1, 1)
_FIELDS = D.RANGE


@query(f"""WITH {RANGES}, fl AS (SELECT *, DATE '{FLOOR}' AS fd, least({', '.join(_FIELDS)}) AS mn, coalesce(coalesce(fa_recommended, fc_recommended) < DATE '{FLOOR}', false) AS pre FROM rg),
mv AS (SELECT *, CASE WHEN mn < fd AND pre THEN (fd - mn)::INT ELSE 0 END AS sh FROM fl)
SELECT o_orderkey, coalesce(mn < fd AND pre, false) AS start_anchored, list_aggregate(list_filter([{', '.join(f"CASE WHEN {c} < fd THEN '{c}' END" for c in _FIELDS)}], lambda x: x IS NOT NULL), 'string_agg', ';') AS early,
{', '.join(f"CASE WHEN coalesce(mn < fd AND pre, false) THEN {c} + sh WHEN {c} < fd THEN fd ELSE {c} END AS {c}" for c in _FIELDS)} FROM mv""")
def date_floor(t: Tables) -> DataFrame:
    out = D.with_date_range(formulas(t), "parsed", "anchor_date", "sub_type", F.lit(FLOOR))
    return out.select("o_orderkey", "start_anchored", F.when(F.size("floored_fields") > 0, F.array_join("floored_fields", ";")).alias("early"), *D.RANGE)


@query("""WITH s AS (SELECT l_orderkey, max(l_shipdate)::DATE AS ship FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN coalesce(ship, d) ELSE coalesce(d, ship) END + 6210 AS anchored FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS d FROM orders) LEFT JOIN s ON l_orderkey = o_orderkey""")
def anchor_shift(t: Tables) -> DataFrame:
    ship = t.lineitem.groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("ship"))
    words = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("P.O"), F.lit("FOB"))).when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("Delivery"))).otherwise(F.array(F.lit("P.O")))
    start = F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate"))
    shift = D.start_shift(F.lit("2024-03-01"))
    return t.orders.join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", D.anchor_date(start, "ship", words, shift).alias("anchored"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS parsed FROM orders""")
def multi_format_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    shapes = [F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.date_format(d, "dd-MMM-yy"), F.lit("*")), F.date_format(d, "d-MMM-yyyy"), F.lit("next week")]
    return t.orders.select("o_orderkey", D.parse_date(F.element_at(F.array(*shapes), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("parsed"))


@query(f"""WITH {RANGES} SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_date' WHEN fa_recommended IS NULL AND fc_recommended IS NULL THEN 'missing_date_range' WHEN fa_recommended IS NULL THEN 'missing_fa' WHEN fc_recommended IS NULL THEN 'missing_fc' ELSE 'generated' END AS status,
  CASE 1 + o_orderkey % 4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 ELSE 0.2 END::DOUBLE AS confidence FROM rg""")
def date_status(t: Tables) -> DataFrame:
    out = D.with_date_range(formulas(t), "parsed", "anchor_date", "sub_type")
    shown = F.when(F.col("o_orderkey") % 11 != 0, F.col("anchor_date"))
    return out.select("o_orderkey", D.date_status(shown).alias("status"), D.range_confidence((F.col("o_orderkey") % 4 + 1).cast("int")).alias("confidence"))


# Match qualities for each line item: the columns that operators.quality reads, from its keys and quantities.
_PICK = {
    "rule_guard": ("l_linenumber", ("passed", "passed", "passed", "rejected")), "rule_family": ("l_partkey", ("match", "match", "compatible", "mismatch", "missing_rule_family")),
    "rule_subtype": ("l_suppkey", ("match", "compatible", "match", "unknown", "mismatch", "match")), "rule_scope": ("l_orderkey", ("match", "rule_generic", "match", "query_unscoped", "mismatch", "match", "match")),
    "activity_phase_status": ("l_partkey", ("match", "compatible", "match", "mismatch", "query_unknown", "match", "match")), "activity_scope_status": ("l_suppkey", ("match", "match", "activity_unscoped", "discipline_only", "mismatch")),
    "activity_scope_source": ("l_orderkey", ("query", "query", "rule")), "query_phase": ("l_orderkey", ("system_design", "procurement", "manual")), "activity_phase": ("l_suppkey", ("procurement", "system_design", "delivery")),
    "date_status": ("l_orderkey", ("generated", "generated", "fi_complete", "generated", "skip", "no_rule", "missing_fa", "generated", "generated", "generated", "generated")),
    "candidate_status": ("l_partkey", ("accepted", "accepted", "", "needs_review")),
}
_FLAGS = {"has_rule": "l_orderkey % 13 <> 0", "has_activity": "l_orderkey % 17 <> 0", "activity_generic": "l_partkey % 9 = 0", "activity_agrees": "l_suppkey % 8 <> 0", "date_default_fc": "l_linenumber % 2 = 0", "start_anchored": "l_partkey % 12 = 0", "floor_collapsed": "l_suppkey % 14 = 0"}
_NUMBERS = {
    "rule_score": "(l_partkey % 10) / 10.0", "rule_semantic": "(l_suppkey % 10) / 10.0", "activity_semantic": "(l_orderkey % 10) / 10.0", "activity_rrf": "(l_partkey % 30) / 1000.0",
    "activity_adjusted": "(l_partkey % 30) / 2000.0", "concept_similarity": "(l_suppkey % 20) / 20.0",
}


def matches(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    picked = {k: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col(c) % len(vs) + 1).cast("int")) for k, (c, vs) in _PICK.items()}
    df = df.withColumns(picked | {k: F.expr(e) for k, e in _FLAGS.items()} | {k: F.expr(e).cast("double") for k, e in _NUMBERS.items()})
    score = F.when(F.col("l_linenumber") < 6, F.format_string("%.2f", 0.7 + (F.col("l_partkey") % 20) / 100.0))
    return df.withColumns({"rule_guard_reason": F.lit("scope_mismatch"), "match_score": score, "generic_bucket": F.when(F.col("l_partkey") % 3 == 0, F.when(F.col("l_suppkey") % 2 == 0, "safe").otherwise("ambiguous")), "generic_verdict": F.when(F.col("l_partkey") % 6 == 3, "use_specific")})


_MATCHES = "mt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{_list(vs)}[1 + {c} % {len(vs)}] AS {k}" for k, (c, vs) in _PICK.items()) + ", " + ", ".join(f"({e}) AS {k}" for k, e in _FLAGS.items()) + ", " + ", ".join(f"({e})::DOUBLE AS {k}" for k, e in _NUMBERS.items()) + """,
  'scope_mismatch' AS rule_guard_reason, CASE WHEN l_linenumber < 6 THEN round(0.7 + (l_partkey % 20) / 100.0, 2)::DOUBLE END AS sc, CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'safe' ELSE 'ambiguous' END END AS bucket, CASE WHEN l_partkey % 6 = 3 THEN 'use_specific' END AS verdict FROM lineitem)"""
_UNC = "('compatible', 'unknown', 'missing_rule_family', 'missing_query_family')"
_OPN = "('rule_generic', 'query_unscoped', 'no_rule')"


def _why(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


_LOW = "(rule_score < 0.5 AND NOT (rule_family = 'match' AND rule_subtype = 'match' AND rule_semantic >= 0.6 AND rule_scope <> 'mismatch'))"
_RB = _why(("rule_guard = 'rejected'", "'rule_guard_rejected:' || rule_guard_reason"), ("rule_family = 'mismatch'", "'rule_family_mismatch'"), ("rule_subtype = 'mismatch'", "'rule_subtype_mismatch'"), ("rule_scope = 'mismatch'", "'rule_scope_mismatch'"), (_LOW, "'rule_score_below_gate'"), (f"{_LOW} AND rule_scope IN {_OPN}", "'rule_scope_ambiguous:' || rule_scope"), (f"{_LOW} AND rule_family IN {_UNC}", "'rule_family_uncertain:' || rule_family"))
_AB = _why(("activity_phase_status = 'mismatch'", "'activity_phase_mismatch'"), ("activity_scope_status = 'mismatch'", "'activity_scope_mismatch'"), ("activity_scope_source = 'rule' AND activity_scope_status <> 'match' AND NOT (activity_scope_status = 'activity_unscoped' AND activity_phase_status IN ('match', 'compatible') AND activity_semantic >= 0.55 AND activity_rrf >= 0.01)", "'activity_rule_scope_unmatched'"), ("activity_rrf < 0.01", "'activity_rrf_below_gate'"), ("activity_generic AND activity_adjusted < 0.005", "'activity_generic_low_confidence'"), ("query_phase IN ('system_design', 'design_drawing', 'design_criteria', 'civil_design') AND activity_phase = 'procurement'", "'activity_phase_procurement_conflict'"))
_GATE = f"gt AS (SELECT *, CASE WHEN has_rule THEN {_RB} ELSE [] END AS rb, CASE WHEN has_activity THEN {_AB} ELSE [] END AS ab FROM mt)"


@query(f"""WITH {_MATCHES}, {_GATE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(rb) > 0 AND len(ab) > 0 THEN 'blocked_rule_activity' WHEN len(rb) > 0 THEN 'blocked_rule' WHEN len(ab) > 0 THEN 'blocked_activity' ELSE 'generated' END AS gate,
coalesce(list_aggregate(list_concat(rb, ab), 'string_agg', ';'), '') AS why FROM gt""")
def date_gate(t: Tables) -> DataFrame:
    g = Q.gate(Q.rule_block_reasons(), Q.activity_block_reasons())
    return matches(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.alias("g")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("g.status").alias("gate"), F.array_join("g.reasons", ";").alias("why"))


_F = lambda *ps: " * ".join(f"(CASE WHEN {c} THEN {v} ELSE 1.0::DOUBLE END)" for c, v in ps)
_RV = _F(("rule_family = 'mismatch'", 0.3), (f"rule_family IN {_UNC}", 0.75), ("rule_subtype = 'mismatch'", 0.3), ("rule_subtype IN ('compatible', 'unknown')", 0.9), ("rule_scope = 'mismatch'", 0.3), (f"rule_scope IN {_OPN}", 0.8), ("rule_score < 0.3", 0.7), ("rule_score >= 0.3 AND rule_score < 0.5", 0.85))
_AV = _F(("activity_phase_status = 'mismatch'", 0.3), ("activity_phase_status IN ('compatible', 'query_unknown', 'activity_unknown')", 0.75), ("activity_scope_status = 'match' AND NOT activity_agrees", 0.4), ("activity_scope_status = 'mismatch'", 0.3), ("activity_scope_status = 'discipline_only'", 0.5), ("activity_scope_status IN ('activity_unscoped', 'query_unscoped')", 0.8), ("activity_scope_source = 'rule' AND activity_scope_status <> 'match'", 0.5), ("activity_generic", 0.8), ("activity_rrf < 0.02", 0.85))
_TR = "(has_rule AND has_activity AND rule_family = 'match' AND rule_subtype = 'match' AND rule_guard = 'passed' AND activity_scope_status <> 'mismatch' AND activity_agrees)"


@query(f"""WITH {_MATCHES}, {_GATE},
cp AS (SELECT *, CASE WHEN candidate_status NOT IN ('', 'accepted') THEN 0.4 WHEN sc IS NULL THEN 1.0 WHEN sc >= 0.82 THEN 1.0 WHEN sc >= 0.78 THEN 0.85 WHEN sc >= 0.75 THEN 0.7 ELSE 0.5 END::DOUBLE AS cv,
  CASE WHEN NOT has_rule THEN 0.5 WHEN rule_guard = 'rejected' THEN 0.1 ELSE {_RV} END AS rv, CASE WHEN NOT has_activity THEN 0.5 ELSE {_AV} END AS av, CASE WHEN NOT has_rule THEN 0.0 WHEN date_default_fc THEN 0.9 ELSE 1.0 END::DOUBLE AS dv,
  (NOT has_rule OR rule_guard = 'rejected' OR 'mismatch' IN (rule_family, rule_subtype, rule_scope)) AS rr,
  (NOT has_activity OR activity_phase_status = 'mismatch' OR (activity_scope_status = 'match' AND NOT activity_agrees) OR activity_scope_status = 'mismatch' OR (activity_scope_source = 'rule' AND activity_scope_status <> 'match')) AS ar,
  ((has_rule AND rule_guard <> 'rejected' AND (rule_family IN {_UNC} OR rule_scope = 'query_unscoped' OR (rule_scope = 'rule_generic' AND NOT coalesce(bucket = 'safe', false))))) AS amb FROM gt),
cf AS (SELECT *, least(cv * rv * av * dv, CASE WHEN rr THEN 0.4 END, CASE WHEN ar THEN 0.5 END, CASE WHEN has_activity AND activity_generic THEN 0.8 END, CASE WHEN date_default_fc THEN 0.9 END,
  CASE WHEN start_anchored AND {_TR} THEN 0.55 END, CASE WHEN start_anchored AND NOT {_TR} THEN 0.3 END, CASE WHEN floor_collapsed THEN 0.4 END) AS conf FROM cp),
st AS (SELECT *, CASE WHEN candidate_status NOT IN ('', 'accepted') THEN 'needs_review_candidate' WHEN rr THEN 'needs_review_rule' WHEN ar THEN 'needs_review_activity'
  WHEN conf >= 0.55 AND NOT amb AND NOT floor_collapsed THEN 'usable' WHEN {_TR} AND activity_scope_status = 'match' AND activity_phase_status IN ('match', 'compatible') AND concept_similarity >= 0.7 AND NOT amb AND NOT floor_collapsed THEN 'usable' ELSE 'needs_review' END AS s0,
  CASE WHEN date_status = 'skip' THEN 'skip' WHEN date_status = 'no_rule' THEN 'blocked_no_rule' WHEN date_status IN ('generated', 'fi_complete') THEN '' ELSE 'blocked_missing_date' END AS e FROM cf)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN e <> '' THEN e WHEN date_status = 'fi_complete' AND s0 = 'usable' THEN 'fi_complete' ELSE s0 END AS status, CASE WHEN e = '' THEN round(conf, 12) ELSE 0.0 END::DOUBLE AS confidence FROM st""")
def schedule_confidence(t: Tables) -> DataFrame:
    out = Q.with_schedule_quality(matches(t), name="q")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q.status", "q.confidence")

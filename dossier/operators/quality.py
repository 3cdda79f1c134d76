"""Gates, quality components and the final confidence of a scheduled document.

A row carries the rule match (rule_guard, rule_guard_reason, rule_family,
rule_subtype, rule_scope, rule_score, rule_semantic), the activity match
(activity_phase_status, activity_scope_status, activity_scope_source,
activity_generic, activity_agrees, activity_semantic, activity_rrf,
activity_adjusted, query_phase, activity_phase), each with a has_rule /
has_activity flag, and the date outcome (date_status, date_default_fc,
start_anchored, floor_collapsed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ladder, reasons

# Thresholds of the gates and of the status ladder.
RULE_GATE, RULE_CONFIRMED = 0.5, 0.60
ACTIVITY_CONFIRMED, ACTIVITY_RRF_GATE, GENERIC_GATE = 0.55, 0.01, 0.005
USABLE, PROMOTE = 0.55, 0.70
UNCERTAIN_FAMILY = ("compatible", "unknown", "missing_rule_family", "missing_query_family")
OPEN_SCOPE = ("rule_generic", "query_unscoped", "no_rule")
DESIGN_PHASES = ("system_design", "design_drawing", "design_criteria", "civil_design")
AMBIGUOUS = tuple(f"rule_family_status={x}" for x in UNCERTAIN_FAMILY) + ("rule_scope_status=query_unscoped", "rule_scope_status=rule_generic")


def _c(name: str) -> Column:
    return F.col(name)


def _tag(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(_c(name), F.lit("")))


def rule_block_reasons() -> Column:
    """Why a rule can't carry dates. A low score passes where type and meaning confirm the match."""
    confirmed = (_c("rule_family") == "match") & (_c("rule_subtype") == "match") & (_c("rule_semantic") >= RULE_CONFIRMED) & (_c("rule_scope") != "mismatch")
    low = (_c("rule_score") < RULE_GATE) & ~confirmed
    found = reasons(
        (_c("rule_guard") == "rejected", _tag("rule_guard_rejected:", "rule_guard_reason")), (_c("rule_family") == "mismatch", "rule_family_mismatch"),
        (_c("rule_subtype") == "mismatch", "rule_subtype_mismatch"), (_c("rule_scope") == "mismatch", "rule_scope_mismatch"), (low, "rule_score_below_gate"),
        (low & _c("rule_scope").isin(*OPEN_SCOPE), _tag("rule_scope_ambiguous:", "rule_scope")), (low & _c("rule_family").isin(*UNCERTAIN_FAMILY), _tag("rule_family_uncertain:", "rule_family")),
    )
    return F.when(_c("has_rule"), found).otherwise(F.array().cast("array<string>"))


def activity_block_reasons() -> Column:
    unscoped_ok = (_c("activity_scope_status") == "activity_unscoped") & _c("activity_phase_status").isin("match", "compatible") & (_c("activity_semantic") >= ACTIVITY_CONFIRMED) & (_c("activity_rrf") >= ACTIVITY_RRF_GATE)
    found = reasons(
        (_c("activity_phase_status") == "mismatch", "activity_phase_mismatch"), (_c("activity_scope_status") == "mismatch", "activity_scope_mismatch"),
        ((_c("activity_scope_source") == "rule") & (_c("activity_scope_status") != "match") & ~unscoped_ok, "activity_rule_scope_unmatched"),
        (_c("activity_rrf") < ACTIVITY_RRF_GATE, "activity_rrf_below_gate"), (_c("activity_generic") & (_c("activity_adjusted") < GENERIC_GATE), "activity_generic_low_confidence"),
        (_c("query_phase").isin(*DESIGN_PHASES) & (_c("activity_phase") == "procurement"), "activity_phase_procurement_conflict"),
    )
    return F.when(_c("has_activity"), found).otherwise(F.array().cast("array<string>"))


def gate(rule_reasons: Column, activity_reasons: Column) -> Column:
    """Struct (status, reasons): what blocks date generation."""
    r, a = F.size(rule_reasons) > 0, F.size(activity_reasons) > 0
    status = ladder((r & a, "blocked_rule_activity"), (r, "blocked_rule"), (a, "blocked_activity"), otherwise="generated")
    return F.struct(status.alias("status"), F.concat(rule_reasons, activity_reasons).alias("reasons"))


def candidate_component(status: str, score: str) -> tuple[Column, Column]:
    """(component, reason) of the candidate itself; rows without a score column value carry no penalty."""
    s, raw = F.lower(F.trim(F.coalesce(_c(status), F.lit("")))), F.trim(F.coalesce(_c(score).cast("string"), F.lit("")))
    v = raw.try_cast("double")
    off = (s != "") & (s != "accepted")
    value = F.when(off, 0.4).when(raw == "", 1.0).when(v.isNull(), 0.75).when(v >= 0.82, 1.0).when(v >= 0.78, 0.85).when(v >= 0.75, 0.7).otherwise(0.5)
    text = ladder(
        (off, F.concat(F.lit("candidate_status="), s)), ((raw == "") | (v >= 0.82), ""), (v.isNull(), "candidate_score_missing"),
        (v >= 0.78, "candidate_score_medium"), (v >= 0.75, "candidate_score_low"), otherwise="candidate_score_below_threshold",
    )
    return value, text


def _product(*factors: tuple[Column, float]) -> Column:
    out = F.lit(1.0)
    for condition, factor in factors:
        out = out * F.when(condition, factor).otherwise(1.0)
    return out


def rule_component() -> tuple[Column, Column, Column]:
    """(component, needs review, reasons) of the rule match."""
    fam, sub, scope, score = _c("rule_family"), _c("rule_subtype"), _c("rule_scope"), _c("rule_score")
    weak_fam, weak_sub, weak_scope = fam.isin(*UNCERTAIN_FAMILY), sub.isin("compatible", "unknown"), scope.isin(*OPEN_SCOPE)
    value = _product((fam == "mismatch", 0.3), (weak_fam, 0.75), (sub == "mismatch", 0.3), (weak_sub, 0.9), (scope == "mismatch", 0.3), (weak_scope, 0.8), (score < 0.3, 0.7), ((score >= 0.3) & (score < 0.5), 0.85))
    found = reasons(
        (fam == "mismatch", "rule_family_mismatch"), (weak_fam, _tag("rule_family_status=", "rule_family")), (sub == "mismatch", "rule_subtype_mismatch"), (weak_sub, _tag("rule_subtype_status=", "rule_subtype")),
        (scope == "mismatch", "rule_scope_mismatch"), (weak_scope, _tag("rule_scope_status=", "rule_scope")), (score < 0.3, "rule_score_low"), ((score >= 0.3) & (score < 0.5), "rule_score_medium"),
    )
    rejected, missing = _c("rule_guard") == "rejected", ~_c("has_rule")
    review = missing | rejected | (fam == "mismatch") | (sub == "mismatch") | (scope == "mismatch")
    why = F.when(missing, F.array(F.lit("rule_quality_missing"))).when(rejected, F.array(_tag("rule_guard_rejected:", "rule_guard_reason"))).otherwise(found)
    return F.when(missing, 0.5).when(rejected, 0.1).otherwise(value), review, why


def activity_component() -> tuple[Column, Column, Column]:
    """(component, needs review, reasons) of the activity match."""
    phase, scope, source = _c("activity_phase_status"), _c("activity_scope_status"), _c("activity_scope_source")
    weak_phase = phase.isin("compatible", "query_unknown", "activity_unknown")
    unconfirmed = (scope == "match") & ~_c("activity_agrees")
    discipline, open_scope = scope == "discipline_only", scope.isin("activity_unscoped", "query_unscoped")
    by_rule, by_rule_ok = (source == "rule") & (scope != "match"), (source == "rule") & (scope == "match")
    generic, low = _c("activity_generic"), _c("activity_rrf") < 0.02
    value = _product((phase == "mismatch", 0.3), (weak_phase, 0.75), (unconfirmed, 0.4), (scope == "mismatch", 0.3), (discipline, 0.5), (open_scope, 0.8), (by_rule, 0.5), (generic, 0.8), (low, 0.85))
    found = reasons(
        (phase == "mismatch", "activity_phase_mismatch"), (weak_phase, _tag("activity_phase_status=", "activity_phase_status")), (unconfirmed, "activity_equipment_unconfirmed"),
        (scope == "mismatch", "activity_scope_mismatch"), (discipline, "activity_scope_status=discipline_only"), (open_scope, _tag("activity_scope_status=", "activity_scope_status")),
        (by_rule, "activity_rule_scope_unmatched"), (by_rule_ok, "activity_scope_source=rule"), (generic, "activity_generic"), (low, "activity_rrf_low"),
    )
    missing = ~_c("has_activity")
    review = missing | (phase == "mismatch") | unconfirmed | (scope == "mismatch") | by_rule
    return F.when(missing, 0.5).otherwise(value), review, F.when(missing, F.array(F.lit("activity_quality_missing"))).otherwise(found)


def trusted() -> Column:
    """A match that an early date may rest on."""
    both = _c("has_rule") & _c("has_activity")
    return both & (_c("rule_family") == "match") & (_c("rule_subtype") == "match") & (_c("rule_guard") == "passed") & (_c("activity_scope_status") != "mismatch") & _c("activity_agrees")


def promotable(concept: str = "concept_similarity") -> Column:
    green = trusted() & (_c("activity_scope_status") == "match") & _c("activity_phase_status").isin("match", "compatible")
    return green & (F.coalesce(_c(concept), F.lit(-1.0)) >= PROMOTE)


def with_verdict(found: Column, bucket: str = "generic_bucket", verdict: str = "generic_verdict") -> Column:
    """A promoting verdict clears the generic-scope reason; each verdict leaves its own."""
    b, v = _c(bucket), _c(verdict)
    promotes = (b == "safe") | (v == "generic_ok")
    cleared = F.filter(found, lambda r: r != "rule_scope_status=rule_generic")
    told = F.when(promotes, F.concat(F.lit("rule_generic_judge="), b, F.lit(":"), F.coalesce(v, F.lit("safe")))).when(v == "use_specific", F.lit("rule_generic_judge=use_specific")).otherwise(F.lit("rule_generic_judge=uncertain"))
    return F.when(b.isNull(), found).when(promotes, F.array_append(cleared, told)).otherwise(F.array_append(found, told))


def with_schedule_quality(df: DataFrame, candidate_status: str = "candidate_status", score: str = "match_score", name: str = "schedule_quality") -> DataFrame:
    """Adds the struct (status, confidence, reasons); reasons keep the order in which they arise.

    Components are columns of their own on the way, so that each is computed
    once and the generated code stays small.
    """
    kept = df.columns
    df = df.withColumn("_trusted", F.coalesce(trusted(), F.lit(False)))
    for prefix, (value, review, why) in (("_r", rule_component()), ("_a", activity_component())):
        df = df.withColumns({f"{prefix}_value": value, f"{prefix}_review": review, f"{prefix}_why": why})
    c_value, c_reason = candidate_component(candidate_status, score)
    default_fc, anchored, collapsed = _c("date_default_fc"), _c("start_anchored"), _c("floor_collapsed")
    d_value = F.when(~_c("has_rule"), 0.0).when(default_fc, 0.9).otherwise(1.0)
    d_reason = ladder((~_c("has_rule"), "no_rule"), (default_fc, "default_fc_window"))
    df = df.withColumns({"_c_value": c_value, "_c_reason": c_reason, "_d_reason": d_reason})
    caps = (
        F.when(_c("_r_review"), 0.4), F.when(_c("_a_review"), 0.5), F.when(_c("has_activity") & _c("activity_generic"), 0.8), F.when(default_fc, 0.9),
        F.when(anchored, F.when(_c("_trusted"), 0.55).otherwise(0.3)), F.when(collapsed, 0.4),
    )
    found = F.concat(F.filter(F.array("_c_reason", "_d_reason"), lambda x: x != ""), "_r_why", "_a_why")
    df = df.withColumns({"_confidence": F.least(_c("_c_value") * _c("_r_value") * _c("_a_value") * d_value, *caps), "_found": found})
    late = reasons((anchored & _c("_trusted"), "date_range_ntp_anchored"), (anchored & ~_c("_trusted"), "date_range_ntp_anchored_untrusted"), (collapsed, "date_range_floored_to_ntp"))
    df = df.withColumn("_found", F.concat(with_verdict(_c("_found")), late))
    df = df.withColumn("_clear", ~F.arrays_overlap("_found", F.array(*[F.lit(x) for x in AMBIGUOUS])) & ~collapsed)
    status = ladder(
        (_c("_c_reason").startswith("candidate_status="), "needs_review_candidate"), (_c("_r_review"), "needs_review_rule"), (_c("_a_review"), "needs_review_activity"),
        ((_c("_confidence") >= USABLE) & _c("_clear"), "usable"), (promotable() & _c("_clear"), "promoted"), otherwise="needs_review",
    )
    d = _c("date_status")
    early = ladder((d == "skip", "skip"), (d == "no_rule", "blocked_no_rule"), (d.startswith("blocked"), d), (~d.isin("generated", "fi_complete"), "blocked_missing_date"))
    df = df.withColumns({"_status": status, "_early": early})
    found = F.when(_c("_status") == "promoted", F.array_append("_found", F.lit("promoted_deliverable_concept"))).otherwise(_c("_found"))
    status = F.when(_c("_status") == "promoted", "usable").otherwise(_c("_status"))
    status = F.when((d == "fi_complete") & (status == "usable"), "fi_complete").otherwise(status)
    why = ladder(
        (d == "skip", "date_status=skip"), (_c("_early") == "blocked_no_rule", F.when(_c("has_rule") & (_c("rule_guard") == "rejected"), _tag("rule_guard_rejected:", "rule_guard_reason")).otherwise("no_rule")),
        (_c("_early") == "blocked_missing_date", _tag("date_status=", "date_status")), (_c("_early") != "", F.array_join(F.concat(rule_block_reasons(), activity_block_reasons()), ";")), otherwise=F.array_join(found, ";"),
    )
    open_ = _c("_early") == ""
    quality = F.struct(F.when(open_, status).otherwise(_c("_early")).alias("status"), F.when(open_, F.round("_confidence", 12)).otherwise(0.0).alias("confidence"), why.alias("reasons"))
    return df.select(*kept, quality.alias(name))

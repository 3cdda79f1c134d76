"""Rule and activity matching: candidates, guards, best match, rescue, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, ladder, ranked, text_or_blank
from dossier.functions.text import expand_query_tokens, rule_tokens

# Priority weights, families and systems that admit no substitute, tokens without identity.
PRIORITY_WEIGHT = {1: 1.0, 2: 0.85, 3: 0.70}
OTHER_WEIGHT = 0.60
SEMANTIC_WEIGHT = 0.3
LEAST_SCORE = 0.2
MOST_CANDIDATES = 300
RESCUE_BELOW = 0.7
STRUCTURED_LEAD = 1.05
#: Rows of either side in a cell of grid_join, and the most partitions that it asks for.
CELL_ROWS, MOST_PARTS = (1 << 11, 1 << 12), 10_000
STRICT_FAMILIES = ("classification", "curve", "design_recommendation", "painting_specification", "foundation", "diagram", "procedure", "study")
GENERIC_SUBTYPES = ("", "calculation", "data_sheet", "diagram", "drawing", "list", "manual", "procedure", "report", "specification", "technical_specification")
EXCLUSIVE_SYSTEMS = ("fire_protection", "drainage", "cooling_tower")
STOP_TOKENS = ("and", "for", "general", "document", "documents", "drawing", "drawings", "system", "systems", "technical", "with")
# Abbreviations that a query's words spell out.
FULL_NAMES = {
    "heat recovery steam generator": "hrsg", "gas turbine generator": "gtg", "gas turbine": "gt", "steam turbine generator": "stg", "air cooled condenser": "acc",
    "condensate extraction pump": "cep", "boiler feed pump": "bfp", "fuel gas package": "fgp", "balance plant": "bop",
}
COMPATIBLE_FAMILIES = (("specification", "datasheet"), ("specification", "description"), ("datasheet", "specification"), ("drawing", "diagram"), ("diagram", "drawing"))


def query_tokens(document: ColumnOrName, equipment: ColumnOrName = "") -> Column:
    """Tokens of a document and its equipment, with the abbreviations that they spell out."""
    words = F.concat_ws(" ", text_or_blank(document), *([] if isinstance(equipment, str) and not equipment else [text_or_blank(equipment)]))
    return expand_query_tokens(rule_tokens(words), FULL_NAMES)


def rule_candidates(queries: DataFrame, rules: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(query_id, rule_id, token_score) of rules that share a meaningful token with a query.

    queries: query_id, tokens; rules: rule_id, tokens, priority. A query left
    without meaningful tokens has no candidates. The pairs come from an equi
    join on tokens; at most `most` a query by score, priority, then rule_id.
    """
    asked = queries.select("query_id", F.explode(F.array_except("tokens", F.array(*[F.lit(t) for t in STOP_TOKENS]))).alias("token"))
    known = rules.select("rule_id", F.explode("tokens").alias("token"))
    pairs = asked.join(known, "token").select("query_id", "rule_id").distinct()
    full = pairs.join(queries.select("query_id", F.col("tokens").alias("query_tokens")), "query_id").join(rules.select("rule_id", "priority", F.col("tokens").alias("rule_tokens")), "rule_id")
    score = F.size(F.array_intersect("rule_tokens", "query_tokens")) / F.greatest(F.size("rule_tokens"), F.lit(3))
    full = full.select("query_id", "rule_id", "priority", score.alias("token_score"))
    order = ranked(["query_id"], F.desc("token_score"), F.asc("priority"), F.asc("rule_id"))
    return full.withColumn("_r", order).filter(F.col("_r") <= most).drop("_r")


def hybrid_score(token: Column, semantic: Column, priority: Column, weight: float = SEMANTIC_WEIGHT) -> Column:
    table = F.create_map(*[F.lit(v) for p in PRIORITY_WEIGHT.items() for v in p])
    blended = token * (1 - weight) + F.greatest(semantic, F.lit(0.0)) * weight
    return blended * F.coalesce(table[priority], F.lit(OTHER_WEIGHT))


def families_compatible(query: Column, rule: Column) -> Column:
    strict = query.isin(*STRICT_FAMILIES) | rule.isin(*STRICT_FAMILIES)
    pair = F.lit(False)
    for q, r in COMPATIBLE_FAMILIES:
        pair = pair | ((query == q) & (rule == r))
    return (query == rule) | (~strict & pair)


def family_status(query: Column, rule: Column) -> Column:
    return ladder(
        ((query == "") & (rule == ""), "unknown"), (query == "", "missing_query_family"), (rule == "", "missing_rule_family"), (query == rule, "match"),
        (families_compatible(query, rule), "compatible"), otherwise="mismatch",
    )


def subtype_status(query_family: Column, query: Column, rule_family: Column, rule: Column) -> Column:
    """Agreement of subtypes, judged within one family only."""
    generic = query.isin(*GENERIC_SUBTYPES) & rule.isin(*GENERIC_SUBTYPES)
    return ladder(
        ((query == "") | (rule == ""), "unknown"), (query == rule, "match"), (query_family != rule_family, "not_applicable"), (generic, "compatible"), otherwise="mismatch",
    )


def rule_scope_status(query: Column, rule: Column) -> Column:
    return ladder((F.size(query) == 0, "query_unscoped"), (F.size(rule) == 0, "rule_generic"), (F.arrays_overlap(query, rule), "match"), otherwise="mismatch")


def guard_reason(q: Column, r: Column) -> Column:
    """First reason that a rule can't stand for a query; blank where it passes.

    Both are structs of family, subtype, scope (keys), tokens (content tokens);
    the rule's also has specific (its wording names an object).
    """
    exclusive = F.array(*[F.lit(s) for s in EXCLUSIVE_SYSTEMS])
    q_only, r_only = F.array_intersect(q["scope"], exclusive), F.array_intersect(r["scope"], exclusive)
    conflict = (F.size(q_only) > 0) & (F.size(r_only) > 0) & ~F.arrays_overlap(q_only, r_only)
    scoped, rule_scoped = F.size(q["scope"]) > 0, F.size(r["scope"]) > 0
    status = subtype_status(q["family"], q["subtype"], r["family"], r["subtype"])
    same_kind = (q["family"] == r["family"]) & (q["subtype"] == r["subtype"])
    objects = same_kind & (F.size(q["tokens"]) > 0) & (F.size(r["tokens"]) > 0) & ~F.arrays_overlap(q["tokens"], r["tokens"])
    specific_kind = ~q["subtype"].isin(*GENERIC_SUBTYPES) | q["family"].isin("diagram", "specification", "list", "report", "drawing")
    return ladder(
        (q["subtype"] == "painting_specification", "blocked_deliverable_family"), (scoped & rule_scoped & ~F.arrays_overlap(q["scope"], r["scope"]), "scope_mismatch"),
        (scoped & conflict, "system_scope_conflict"), (status == "mismatch", "deliverable_subtype_mismatch"), (q["family"].isin(*STRICT_FAMILIES) & (r["family"] == ""), "missing_rule_family"),
        ((q["family"] != "") & (r["family"] != "") & ~families_compatible(q["family"], r["family"]), "deliverable_family_mismatch"),
        (scoped & q["family"].isin(*STRICT_FAMILIES) & (q["family"] == r["family"]) & ~rule_scoped & r["specific"], "implicit_scope_mismatch"), (objects & specific_kind, "object_token_mismatch"),
    )


def best_rule(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """One row a query from scored pairs (query_id, rule_id, priority, final_score, token_score, guard, query_family, rule_family, subtype_ok, sub_type).

    Passed pairs with a token and a score of LEAST_SCORE count. Specifications
    keep to exact families, then subtypes, then rules that schedule, where there
    are any. Ties: priority, then rule_id. Without a passed pair the best
    rejected one is reported with rule_id null.
    """
    usable = (F.col("guard") == "") & (F.col("token_score") > 0) & (F.col("final_score") >= LEAST_SCORE)
    spec = F.col("query_family") == "specification"
    exact = (spec & (F.col("rule_family") == "specification")).cast("int")
    tiers = [usable.cast("int").desc(), exact.desc(), (exact * F.col("subtype_ok").cast("int")).desc(), (spec & (F.col("sub_type") != "SKIP")).cast("int").desc()]
    order = ranked([by], *tiers, F.desc("final_score"), F.asc("priority"), F.asc("rule_id"))
    best = scored.filter(usable | (F.col("guard") != "")).withColumns({"_ok": usable, "_r": order}).filter("_r = 1")
    return best.withColumn("rule_id", F.when(F.col("_ok"), F.col("rule_id"))).drop("_ok", "_r")


def title_rescue(primary: DataFrame, by_title: DataFrame, by: str = "query_id") -> DataFrame:
    """Primary matches, replaced where weak by a strictly better title match."""
    weak = F.col("p.rule_id").isNull() | (F.col("p.scope_status").isin("rule_generic", "query_unscoped", "no_rule") & (F.col("p.final_score") < RESCUE_BELOW))
    better = F.col("t.rule_id").isNotNull() & (F.col("p.rule_id").isNull() | (F.col("t.final_score") > F.col("p.final_score")))
    use = F.coalesce(weak & better, F.lit(False))
    both = primary.alias("p").join(by_title.alias("t"), by, "left")
    rest = [c for c in primary.columns if c != by]
    return both.select(by, *[F.when(use, F.col(f"t.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in rest], F.when(use, "title").otherwise("primary").alias("query_source"))


def best_activity(candidates: DataFrame, *by: str) -> DataFrame:
    """Highest adjusted score among scope matches, or among all where none matches; then RRF, then shortlist order."""
    order = ranked(by or ["query_id"], (F.col("scope_status") == "match").cast("int").desc(), F.desc("adjusted"), F.desc("rrf"), F.asc("rank"))
    return candidates.withColumn("_r", order).filter("_r = 1").drop("_r")


def prefer_structured(structured: Column, text: Column, conflict: Column) -> Column:
    """Hybrid choice between two adjusted scores: the structured one needs a lead and no procurement conflict."""
    return F.coalesce((structured >= text * STRUCTURED_LEAD) & ~conflict, F.lit(False))


def grid_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join whose result may be far larger than its inputs: the rows of each key are dealt into a grid of CELL_ROWS.

    Each cell is made by one task, and there are as many partitions as cells, so
    that neither a hot key nor a small input gathers the pairs in few tasks. Rows
    of the left side go to the cells of their row, those of the right to the
    cells of their column; each pair meets once.
    """
    from dossier.sources.scratch import settled

    on, (wide, high) = list(on), CELL_ROWS
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_m")), on)
    sizes = settled(sizes.select(*on, F.monotonically_increasing_id().alias("_key_no"), F.ceil(F.col("_n") / wide).cast("int").alias("_rows"), F.ceil(F.col("_m") / high).cast("int").alias("_columns")))
    cells = int(sizes.agg(F.sum(F.col("_rows").cast("long") * F.col("_columns"))).first()[0] or 0)
    parts = max(2 * left.sparkSession.sparkContext.defaultParallelism, min(cells, MOST_PARTS))

    at = ["_key_no", "_row", "_column"]  # read from a table, so that no optimizer folds a constant among them and shuffles again

    def dealt(df: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        keyed = df.join(sizes, on).withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int"))
        return keyed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_rows", "_columns").repartition(parts, *at)

    met = dealt(left, "_rows", "_row", "_columns", "_column").join(dealt(right, "_columns", "_column", "_rows", "_row").drop(*on).hint("shuffle_hash"), at)
    return met.drop(*at)


def cells(left: DataFrame, right: DataFrame, system: str = "systems", phase: str = "phases") -> DataFrame:
    """Pairs that share a (system, phase) cell; both sides list several of each, pairs come once.

    Rows of the same cells are one class. Classes meet by their cells and are made
    distinct, then their members are paired: no pair of rows is shuffled or compared.
    """

    def classed(df: DataFrame, key: str, name: str) -> DataFrame:
        spread = df.select(key, F.explode(system).alias("system"), phase).select(key, "system", F.explode(phase).alias("phase")).dropna(subset=["system", "phase"])
        held = spread.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("system", "phase"))).alias("cells"))
        return held.withColumn(name, F.sha2(F.to_json("cells"), 256))

    queries, activities = classed(left, "query_id", "_l"), classed(right, "activity_id", "_r")
    spread = lambda df, name: df.select(name, "cells").distinct().select(name, F.explode("cells").alias("c")).select(name, "c.*")
    classes = spread(queries, "_l").join(spread(activities, "_r"), ["system", "phase"]).select("_l", "_r").distinct()
    reached = classes.join(activities.select("_r", "activity_id"), "_r").select("_l", "activity_id")
    return grid_join(queries.select("_l", "query_id"), reached, ["_l"]).select("query_id", "activity_id")


def cell_reason_of(has_index: Column, n_systems: Column, n_phases: Column, system_known: Column, n_found: Column) -> Column:
    """Why a structured lookup found nothing; blank where it found something."""
    return ladder(
        (~has_index, "structured_index_missing"), (n_systems == 0, "no_system"), (n_phases == 0, "no_phase"), (n_found > 0, ""), (~system_known, "system_absent"), otherwise="phase_gap",
    )


def mapped(queries: DataFrame, mapping: DataFrame, keys: str = "mapping_keys", scopes: str = "scopes") -> DataFrame:
    """The first mapping row by key order, then scope order, then the wildcard scope.

    queries: query_id, mapping_keys, scopes; mapping: family, scope, phases. A
    query keeps its row with null phases where nothing fits.
    """
    asked = queries.select("query_id", F.posexplode(keys).alias("_k", "family"), F.array_append(F.col(scopes), F.lit("*")).alias("_s"))
    asked = asked.select("query_id", "_k", "family", F.posexplode("_s").alias("_p", "scope"))
    hits = asked.join(mapping, ["family", "scope"]).withColumn("_r", ranked(["query_id"], F.asc("_k"), F.asc("_p"))).filter("_r = 1")
    return queries.join(hits.select("query_id", "family", "scope", "phases"), "query_id", "left")


def competing_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, other_id): a generic rule and a scoped one of its subtype with overlapping scope and another timeline.

    They meet by subtype and scope key; a pair that shares several is taken at the first of them.
    """
    keyed = rules.select("rule_id", "subtype", F.array_distinct("scope").alias("scope"), "timeline", "generic").withColumn("_key", F.explode("scope")).dropna(subset=["subtype", "_key"])
    generic = keyed.filter("generic").drop("generic")
    scoped = keyed.filter("not generic").select(F.col("rule_id").alias("other_id"), "subtype", F.col("scope").alias("other_scope"), F.col("timeline").alias("other_timeline"), "_key")
    pairs = grid_join(generic, scoped, ["subtype", "_key"]).filter(~F.col("timeline").eqNullSafe(F.col("other_timeline")))
    once = (F.size("scope") == 1) | (F.size("other_scope") == 1) | (F.array_min(F.array_intersect("scope", "other_scope")) == F.col("_key"))
    return pairs.filter(once).select("rule_id", "other_id")


def competing_for(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with n_competing and competing: scoped rules of their subtype and scope whose timeline differs from their own rule's.

    rows: kind (subtype, else family), asked (scope keys), timeline; rules:
    rule_id, kind, systems, keyword, timeline. Rows alike are looked up once; a
    list holds one kind's rules of a few systems.
    """
    keyed = rows.withColumn("_case", F.sha2(F.to_json(F.struct("kind", "asked", "timeline")), 256))
    cases = keyed.groupBy("_case").agg(F.first("kind").alias("kind"), F.first("asked").alias("asked"), F.first("timeline").alias("timeline"))
    known = rules.select("rule_id", "kind", "keyword", F.col("timeline").alias("other"), F.explode("systems").alias("system"))
    hits = cases.withColumn("system", F.explode("asked")).join(known, ["kind", "system"]).filter(~F.col("timeline").eqNullSafe(F.col("other")))
    found = hits.groupBy("_case").agg(F.count_distinct("rule_id").alias("n_competing"), F.array_sort(F.collect_set("keyword")).alias("competing"))
    out = keyed.join(found, "_case", "left").drop("_case")
    return out.withColumns({"n_competing": F.coalesce("n_competing", F.lit(0)), "competing": F.coalesce("competing", F.array().cast("array<string>"))})


def generic_bucket(df: DataFrame) -> Column:
    """Of generic-scope matches (scope_status, family_status, subtype_status, n_competing): weak, safe or ambiguous; null for others."""
    confirmed = (F.col("family_status") == "match") & F.col("subtype_status").isin("match", "not_applicable", "")
    return F.when(F.col("scope_status") == "rule_generic", ladder((~confirmed, "weak"), (F.col("n_competing") > 0, "ambiguous"), otherwise="safe"))


# Alignment of a candidate with a requirement's intent.
ALIGN = {"equipment": 0.12, "equipment_mismatch": -0.16, "equipment_missing": -0.04, "system": 0.04, "subtype": 0.18, "subtype_term": 0.04, "family": 0.08, "family_term": 0.03, "term": 0.05, "mismatch": -0.18, "missing": -0.06, "constraint": 0.03}
ALIGNED, WEAK, MISMATCHED = 0.18, 0.02, -0.10


def intent_alignment(df: DataFrame) -> Column:
    """Struct (score, status) from the flags wants_x and has_x of df.

    wants_equipment, equipment_hit, has_equipment; wants_system, system_hit;
    wants_deliverable, subtype_hit, family_hit, term_hit, has_family;
    wants_constraint, constraint_hit.
    """
    c = F.col
    equipment = F.when(~c("wants_equipment"), 0.0).when(c("equipment_hit"), ALIGN["equipment"]).when(c("has_equipment"), ALIGN["equipment_mismatch"]).otherwise(ALIGN["equipment_missing"])
    system = F.when(c("wants_system") & c("system_hit"), ALIGN["system"]).otherwise(0.0)
    term = c("term_hit")
    deliverable = F.when(~c("wants_deliverable"), 0.0).when(c("subtype_hit"), F.when(term, ALIGN["subtype"] + ALIGN["subtype_term"]).otherwise(ALIGN["subtype"]))
    deliverable = deliverable.when(c("family_hit"), F.when(term, ALIGN["family"] + ALIGN["family_term"]).otherwise(ALIGN["family"])).when(term, ALIGN["term"])
    deliverable = deliverable.when(c("has_family"), ALIGN["mismatch"]).otherwise(ALIGN["missing"])
    constraint = F.when(c("wants_constraint") & c("constraint_hit"), ALIGN["constraint"]).otherwise(0.0)
    score = F.round(equipment + system + deliverable + constraint, 4)
    bad = (c("wants_equipment") & ~c("equipment_hit") & c("has_equipment")) | (c("wants_deliverable") & ~c("subtype_hit") & ~c("family_hit") & ~term & c("has_family"))
    asks = c("wants_equipment") | c("wants_system") | c("wants_deliverable") | c("wants_constraint")
    status = ladder((~asks, "unknown"), (bad & (score <= MISMATCHED), "mismatch"), (~bad & (score >= ALIGNED), "aligned"), (score >= WEAK, "weak"), (bad, "mismatch"), otherwise="weak")
    return F.struct(F.when(asks, score).otherwise(0.0).alias("score"), status.alias("status"))


TIERS = (("aligned", None), ("weak", None), ("unknown", 1))


def tiered_selection(rows: DataFrame, most: int = 5, high: float = 0.82, chunk: str = "chunk_id", unique: str = "doc_id") -> DataFrame:
    """Adds selected and reason to rows (chunk_id, doc_id, status, selection_score, score, rank).

    A chunk takes aligned, then weak, then one unknown candidate, `most` in all;
    one mismatch only where it took nothing else. A high score selects aligned
    and weak rows anywhere.
    """
    level = ladder((F.col("status") == "aligned", F.lit(0)), (F.col("status") == "weak", F.lit(1)), (F.col("status") == "unknown", F.lit(2)), otherwise=F.lit(3))
    rows = rows.withColumn("_t", level)
    by_tier = [F.desc("selection_score"), F.asc("rank"), F.asc(unique)]
    rows = rows.withColumn("_n", ranked([chunk, "_t"], *by_tier)).withColumn("_in", (F.col("_t") < 2) | ((F.col("_t") == 2) & (F.col("_n") == 1)))
    rows = rows.withColumn("_place", F.sum(F.col("_in").cast("int")).over(Window.partitionBy(chunk).orderBy("_t", "_n").rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.col("_in") & (F.col("_place") <= most)
    rows = rows.withColumn("_taken", taken).withColumn("_any", F.max("_taken").over(Window.partitionBy(chunk)))
    fallback = ~F.col("_any") & (F.col("_t") == 3) & (F.col("_n") == 1)
    strong = (F.col("score") >= high) & (F.col("_t") < 2)
    name = ladder((F.col("_taken"), F.concat(F.lit(f"top_{most}_"), F.col("status"))), (fallback, F.lit(f"top_{most}_mismatch_fallback")), (strong, f"high_score>={high:.2f}"), otherwise="outside_top_k")
    return rows.withColumns({"reason": name, "selected": F.col("_taken") | fallback | strong}).drop("_t", "_n", "_in", "_place", "_taken", "_any")

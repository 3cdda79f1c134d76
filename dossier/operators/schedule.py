"""From documents, rules and activities to dated rows with a quality: the whole chain, each step an operator of its own.

Rules are looked up by a document's deliverable and equipment and, where that
match is weak, by its title. Activities are ranked twice: all of them by words
and by vectors, and those of the document's systems and phases among themselves;
the hybrid resolver takes the second where it leads. Nothing of the document
table reaches the driver; activities are a broadcast matrix of a checked size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import dates as D
from dossier.functions import vocabulary as V
from dossier.functions.columns import ladder, strings, text_or_blank
from dossier.operators import audit as A
from dossier.operators import matching as M
from dossier.operators import quality as Q
from dossier.operators import records as R
from dossier.operators import registers as G
from dossier.operators.listing import joined_alike, numbered
from dossier.operators.providers import Embedder, Judge, PairScorer, concept_similarity, embed_texts, judge_rows, score_pairs
from dossier.operators.shortlist import two_channel_shortlist
from dossier.sources.scratch import settled

RETRIEVE, SHORTLIST = 50, 20
MODES = ("text", "structured", "hybrid")
FIELDS = ("title", "equipment", "system", "building", "deliverable")
CANDIDATE = ("candidate_status", "match_score")
RULE = ("rule_id", "rule_family", "rule_subtype", "rule_scopes", "rule_systems", "doc_keyword", "activity_keywords", "sub_type", "vt", "priority", "guard", "token_score", "semantic_score", "final_score")
ACTIVITY = ("activity_id", "activity_name", "wbs_path", "start_date", "finish_date", "activity_phase", "activity_scopes", "phase_status", "activity_scope_status", "generic", "agrees", "a_rank", "b_rank", "a_score", "b_score", "rrf", "adjusted")
VERDICTS = ("generic_ok", "use_specific", "uncertain")
MAPPING = "family string, scope string, phases array<string>"


def described(docs: DataFrame) -> DataFrame:
    """docs (doc_id, FIELDS and, where there are any, the CANDIDATE columns) with what the matchers read."""
    held = [text_or_blank(F.col(c).cast("string")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in CANDIDATE]
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.trim(text_or_blank(c)).alias(c) for c in FIELDS], *held)
    df = df.withColumn("refined", V.normalize_deliverable(G.refine_deliverable("deliverable", "title")))
    df = df.withColumn("kind", V.deliverable_type("refined", "title"))
    # what a rule is looked up by: the deliverable and its scope, which only titles without structured fields give
    where = F.trim(F.concat_ws(" ", "equipment", "system", "building"))
    where = F.when(where != "", where).otherwise(R.joined(V.scope_keys("title"), " "))
    df = df.withColumns({"family": F.col("kind.family"), "subtype": F.col("kind.subtype"), "rule_text": F.trim(F.concat_ws(" ", "refined", where)), "tokens": M.query_tokens("refined", where), "title_tokens": M.query_tokens("title")})
    structured = V.scope_keys(F.concat_ws(" ", "equipment", "system", "building"))
    df = df.withColumns({"_structured": structured, "_title": V.scope_keys("title")})
    df = df.withColumn("scopes", V.document_scope(F.col("_structured"), F.col("_title"), F.array().cast("array<string>"))["keys"])
    return df.withColumns({"rule_scopes_asked": A.rule_scope_keys(F.concat_ws(" ", "equipment", "system", "building", "title")), "content": A.free_tokens("title")}).drop("kind", "_structured", "_title")


def described_rules(rules: DataFrame) -> DataFrame:
    """rules (rule_id, priority, item, doc_keyword, activity_keywords, sub_type, vt) with family, subtype, scopes and tokens."""
    df = rules.withColumn("kind", V.deliverable_type("doc_keyword", F.lit("")))
    text = R.semantic_text("doc_keyword", "item")
    return df.select(
        "rule_id", "priority", "item", "doc_keyword", "activity_keywords", "sub_type", "vt", F.col("kind.family").alias("rule_family"), F.col("kind.subtype").alias("rule_subtype"),
        A.rule_scope_keys(text).alias("rule_scopes"), V.scope_keys(text).alias("rule_systems"), M.rule_tokens("doc_keyword").alias("rule_tokens"), A.free_tokens("doc_keyword").alias("rule_content"), text.alias("rule_text"),
    )


def rule_matches(queries: DataFrame, rules: DataFrame, scorer: PairScorer) -> DataFrame:
    """The best rule of each query (rule_id null where none passes) and the columns of its quality; queries without a candidate have none.

    queries: described docs with query_text and tokens, by query_id.
    """
    pairs = M.rule_candidates(queries.select("query_id", "tokens"), rules.select("rule_id", F.col("rule_tokens").alias("tokens"), "priority")).drop("priority")
    both = pairs.join(queries.select("query_id", "query_text", "family", "subtype", "rule_scopes_asked", "content"), "query_id").join(rules, "rule_id")
    side = lambda family, subtype, scope, tokens, *more: F.struct(F.col(family).alias("family"), F.col(subtype).alias("subtype"), F.col(scope).alias("scope"), F.col(tokens).alias("tokens"), *more)
    specific = (R.rule_scope_type(F.col("rule_scopes"), "doc_keyword") != "generic").alias("specific")
    both = both.withColumn("guard", M.guard_reason(side("family", "subtype", "rule_scopes_asked", "content"), side("rule_family", "rule_subtype", "rule_scopes", "rule_content", specific)))
    both = score_pairs(both, "query_text", "rule_text", scorer, "semantic_score")
    both = both.withColumn("final_score", M.hybrid_score(F.col("token_score"), F.col("semantic_score"), F.col("priority")))
    both = both.withColumns({"subtype_ok": F.col("subtype") == F.col("rule_subtype"), "query_family": F.col("family")})
    status = F.when(F.col("rule_id").isNull(), "no_rule").otherwise(M.rule_scope_status(F.col("rule_scopes_asked"), F.col("rule_scopes")))
    return M.best_rule(both).withColumn("scope_status", status).select("query_id", "scope_status", *RULE)


def matched_rules(docs: DataFrame, rules: DataFrame, scorer: PairScorer) -> DataFrame:
    """described docs with their best rule: by deliverable and equipment or, where that is weak, by title."""
    titled = (F.col("title") != "") & (F.col("title") != F.col("rule_text"))
    asked = lambda k, text, words: F.struct(F.lit(k).alias("by_title"), F.col(text).alias("text"), F.col(words).alias("words"))
    # both wordings of a document go through join, guards and scorer together
    both = docs.withColumn("w", F.explode(F.array_compact(F.array(asked(0, "rule_text", "tokens"), F.when(titled, asked(1, "title", "title_tokens"))))))
    both = both.withColumns({"query_id": F.col("doc_id") * 2 + F.col("w.by_title"), "query_text": F.col("w.text"), "tokens": F.col("w.words")}).drop("w", "doc_id")
    found = rule_matches(both, rules, scorer).withColumns({"by_title": F.pmod("query_id", F.lit(2)), "doc_id": F.shiftright("query_id", 1)})
    sides = found.groupBy("doc_id").agg(*[F.max(F.when(F.col("by_title") == k, F.struct("scope_status", *RULE))).alias(c) for k, c in ((0, "p"), (1, "t"))])
    primary = docs.select(F.col("doc_id").alias("query_id")).join(sides.select(F.col("doc_id").alias("query_id"), "p.*"), "query_id", "left")
    chosen = M.title_rescue(primary, sides.select(F.col("doc_id").alias("query_id"), "t.*").filter("rule_id is not null"))
    return docs.join(chosen.drop("scope_status").withColumnRenamed("query_id", "doc_id"), "doc_id", "left")


def with_verdicts(rows: DataFrame, rules: DataFrame, judge: Judge | None) -> DataFrame:
    """rows with the generic_bucket of their rule and its generic_verdict; the judge answers each distinct case once, and is uncertain where there is none."""
    there, timeline = F.col("rule_id").isNotNull(), F.to_json(F.struct("sub_type", "vt"))
    named = lambda subtype, family: F.when(F.col(subtype) != "", F.col(subtype)).otherwise(F.col(family))
    df = rows.withColumns({"kind": named("subtype", "family"), "asked": F.when(there, F.col("rule_scopes_asked")), "timeline": timeline})
    df = M.competing_for(df, rules.select("rule_id", named("rule_subtype", "rule_family").alias("kind"), F.col("rule_systems").alias("systems"), F.col("doc_keyword").alias("keyword"), timeline.alias("timeline")))
    df = df.withColumns({
        "scope_status": F.when(there, M.rule_scope_status(F.col("rule_scopes_asked"), F.col("rule_scopes"))), "family_status": M.family_status(F.col("family"), F.col("rule_family")),
        "subtype_status": M.subtype_status(F.col("family"), F.col("subtype"), F.col("rule_family"), F.col("rule_subtype")),
    })
    df = df.withColumn("generic_bucket", M.generic_bucket(df))
    unclear = F.col("generic_bucket") == "ambiguous"
    if judge is None:
        df = df.withColumn("generic_verdict", F.when(unclear, "uncertain"))
    else:
        where = F.when(F.col("equipment") != "", F.col("equipment")).otherwise(F.col("system"))
        case = F.to_json(F.struct(F.upper("deliverable").alias("deliverable"), F.upper(where).alias("equipment"), F.col("doc_keyword").alias("generic_rule"), F.col("sub_type").alias("submission_type"), F.col("timeline").alias("timeline"), F.col("competing").alias("competing_rules")))
        df = judge_rows(df.withColumn("_case", F.when(unclear, case)), "_case", judge, "_answer")
        df = df.withColumn("generic_verdict", F.when(unclear, F.when(F.col("_answer").isin(*VERDICTS), F.col("_answer")).otherwise("uncertain"))).drop("_case", "_answer")
    return df.drop("kind", "asked", "timeline", "scope_status", "family_status", "subtype_status", "n_competing").withColumnRenamed("competing", "competing_rules")


def with_concept(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """rows with concept_similarity: the document's deliverable against its rule's keyword, free of scope; null without a rule."""
    named = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("deliverable", "subtype", "family", "title")])
    df = rows.withColumns({"_mine": F.when(F.col("rule_id").isNotNull(), named), "_theirs": F.when(F.col("rule_id").isNotNull(), F.col("doc_keyword"))})
    return concept_similarity(df, "_mine", "_theirs", embedder).drop("_mine", "_theirs")


def mapping_key() -> Column:
    """What a deliverable's own mapping row is filed under; null for most, which have their family's only."""
    own = F.col("family").isin("diagram", "classification", "curve")
    return F.when(F.col("subtype") == "p_id", "p&id").when(F.col("subtype").isin("technical_specification", "system_description"), F.col("subtype")).when(own, F.col("family"))


def allowed_phases(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with cell_phases: those of the first mapping row by deliverable and scope, else the bucket of the query phase."""
    asked = rows.select(F.col("doc_id").alias("query_id"), F.array_distinct(F.array_compact(F.array(mapping_key(), "family"))).alias("mapping_keys"), F.col("effective.keys").alias("scopes"))
    usable = mapping.filter(F.size("phases") > 0)
    by_rule = M.mapped(asked, usable).select(F.col("query_id").alias("doc_id"), F.col("phases").alias("_mapped"))
    bucket = F.create_map(*[x for q, phases in V.PHASE_BUCKETS.items() for x in (F.lit(q), strings(phases))])[F.col("query_phase")]
    own = F.when(F.col("query_phase") != "", F.coalesce(bucket, F.array("query_phase"))).otherwise(F.array().cast("array<string>"))
    return rows.join(by_rule, "doc_id", "left").withColumn("cell_phases", F.array_distinct(F.coalesce("_mapped", own))).drop("_mapped")


def resolved(mode: str, known_systems: Sequence[str]) -> tuple[Column, Column]:
    """(whether the cell's activity is taken, why) from the structs t and c of a row's best activities and its scope and phases."""
    conflict = F.col("query_phase").isin(*Q.DESIGN_PHASES) & (F.col("c.activity_phase") == "procurement")
    use = M.prefer_structured(F.col("c.adjusted"), F.coalesce(F.col("t.adjusted"), F.lit(0.0)), conflict) if mode != "text" else F.lit(False)
    there = F.col("c").isNotNull()
    missing = M.cell_reason_of(F.lit(True), F.size("effective.keys"), F.size("cell_phases"), F.arrays_overlap("effective.keys", strings(known_systems)), F.lit(0))
    why = ladder((use, "structured_preferred"), (there & conflict, "structured_blocked_procurement_conflict"), (there, "structured_cell_found_text_preferred"), otherwise=F.concat(F.lit("structured_"), missing))
    return use, (F.lit("text_rrf") if mode == "text" else why)


def matched_activities(rows: DataFrame, activities: DataFrame, embedder: Embedder, mapping: DataFrame | None = None, mode: str = "hybrid") -> DataFrame:
    """rows with their best activity and how it was found (resolution).

    Shortlists hold all activities by words and vectors, in the phases that the
    document's own is open to, and those of its cells. In structured mode a row
    whose cell gives none keeps the activity by text for show, with scores of 0.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    none, has_rule = F.array().cast("array<string>"), F.col("rule_id").isNotNull()
    keywords = F.when(has_rule, F.col("activity_keywords"))
    asked = rows.withColumns({
        "activity_query": V.activity_query("equipment", "system", "deliverable", "title", keywords), "query_phase": V.query_phase("refined", "title", F.concat_ws(" ", "equipment", "system", "building"), keywords),
        "rule_phase": F.coalesce(V.keyword_phase(keywords), F.lit("")), "effective": R.effective_scope(F.col("scopes"), F.coalesce(F.when(has_rule, F.col("rule_systems")), none)),
    })
    asked = allowed_phases(settled(asked), asked.sparkSession.createDataFrame([], MAPPING) if mapping is None else mapping)
    known = activities.withColumn("activity_text", F.concat_ws(" ", "activity_name", "wbs_path")).withColumns({"activity_phase": V.activity_phase("activity_text"), "activity_scopes": V.scope_keys("activity_text")})
    known = settled(known)
    matrix = embed_texts(known.select("activity_id", "activity_text", "activity_phase", "activity_scopes"), "activity_text", embedder)
    matrix = matrix.select("activity_id", F.col("activity_text").alias("text"), "vector", F.col("activity_phase").alias("phase"), F.col("activity_scopes").alias("systems"))
    queries = embed_texts(asked.select("doc_id", "activity_query", "query_phase", "effective", "cell_phases"), "activity_query", embedder)
    queries = queries.select(F.col("doc_id").alias("query_id"), F.col("activity_query").alias("text"), "vector", F.col("query_phase").alias("phase"), F.col("effective.keys").alias("systems"), "cell_phases")
    short = two_channel_shortlist(queries, matrix, RETRIEVE, SHORTLIST).withColumnRenamed("query_id", "doc_id")

    both = short.join(asked.select("doc_id", "title", "equipment", "query_phase", "rule_phase", "effective"), "doc_id").join(known.drop("activity_text"), "activity_id")
    both = both.withColumns({
        "phase_status": V.phase_status("query_phase", "activity_phase", "rule_phase"), "activity_scope_status": V.scope_status(F.col("effective.keys"), F.col("activity_scopes")),
        "generic": R.generic_activity("activity_name", F.lit(""), "wbs_path"), "agrees": V.equipment_agreement(F.concat_ws(" ", "equipment", "title"), "activity_name", F.col("activity_scopes")),
    })
    both = both.withColumn("adjusted", V.adjusted_score("rrf", "phase_status", "activity_scope_status", F.col("generic"), F.col("effective.source") == "rule"))
    both = both.withColumns({"scope_status": F.col("activity_scope_status"), "cell_size": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "source"))})
    best = M.best_activity(both, "doc_id", "source")
    sides = best.groupBy("doc_id").agg(*[F.max(F.when(F.col("source") == k, F.struct(*ACTIVITY, "cell_size"))).alias(c) for k, c in (("text", "t"), ("cell", "c"))])
    systems = sorted(r[0] for r in known.select(F.explode("activity_scopes")).distinct().collect())  # keys of a fixed table
    use, why = resolved(mode, systems)
    out = asked.join(sides, "doc_id", "left").withColumns({"_use": use, "resolution": why})
    out = out.withColumn("_a", F.when(F.col("_use"), F.col("c")).otherwise(F.col("t")))
    abstains = (F.lit(mode == "structured") & ~F.col("_use")) if mode == "structured" else F.lit(False)
    zeroed = {c: F.when(abstains, 0.0).otherwise(F.col(f"_a.{c}")) for c in ("rrf", "adjusted")}
    out = out.withColumns({c: zeroed.get(c, F.col(f"_a.{c}")) for c in ACTIVITY} | {"structured_cell_size": F.when(F.col("_use"), F.col("_a.cell_size")).otherwise(0), "scope_source": F.col("effective.source")})
    return out.withColumns({"scope_source": F.when(F.col("activity_id").isNotNull(), F.col("scope_source")), "activity_semantic": F.col("b_score")}).drop("_use", "_a", "t", "c")


def with_match_records(rows: DataFrame) -> DataFrame:
    """rows with the rule_match_ and activity_match_ columns of their quality, as text."""
    none = F.array().cast("array<string>")
    blended = F.col("token_score") * (1 - M.SEMANTIC_WEIGHT) + F.greatest("semantic_score", F.lit(0.0)) * M.SEMANTIC_WEIGHT
    rule = {"query_family": "family", "query_subtype": "subtype", "query_scopes": "rule_scopes_asked", "rule_keyword": "doc_keyword"}
    same = ("rule_id", "query_source", "rule_family", "rule_subtype", "rule_scopes", "guard", "token_score", "semantic_score", "final_score")
    df = rows.select(F.struct(*rows.columns).alias("_row"), *same, *[F.col(c).alias(k) for k, c in rule.items()], blended.alias("hybrid_score"))
    df = R.with_rule_quality(df)
    made = [c for c in df.columns if c.startswith("rule_match_")]
    activity = {"query_scopes": "scopes", "rule_scopes": "rule_systems", "agreement": "agrees", "bm25_rank": "a_rank", "semantic_rank": "b_rank", "bm25_score": "a_score", "semantic_score": "b_score", "rrf_score": "rrf", "adjusted_score": "adjusted"}
    same = ("query_phase", "rule_phase", "activity_name", "wbs_path")
    value = lambda k, c: (F.coalesce(F.col(f"_row.{c}"), none) if k.endswith("scopes") else F.col(f"_row.{c}")).alias(k)
    df = df.select("_row", *made, *[F.col(f"_row.{c}").alias(c) for c in same], F.lit("").alias("activity_name_clean"), *[value(k, c) for k, c in activity.items()])
    df = R.with_activity_quality(df)
    there = F.col("_row.activity_id").isNotNull()
    return df.select("_row.*", *made, *[F.when(there, F.col(c)).otherwise("").alias(c) for c in df.columns if c.startswith("activity_match_")])


def dated(rows: DataFrame, floor: Column | None = None) -> DataFrame:
    """rows with the six dates of their rule's formula at their activity, where the gates let them through, and date_status."""
    df = rows.withColumns({"has_rule": F.col("rule_id").isNotNull(), "has_activity": F.col("activity_id").isNotNull(), "anchor": D.anchor_date("start_date", "finish_date", F.coalesce("activity_keywords", F.array().cast("array<string>")))})
    none = F.lit("").cast("string")
    df = df.withColumns({
        "rule_guard": ladder((~F.col("has_rule"), "no_match"), otherwise="passed"), "rule_guard_reason": F.coalesce("guard", none),
        "rule_scope": F.when(F.col("has_rule"), M.rule_scope_status(F.col("rule_scopes_asked"), F.col("rule_scopes"))).otherwise("no_rule"), "rule_score": F.coalesce("final_score", F.lit(0.0)), "rule_semantic": F.coalesce("semantic_score", F.lit(0.0)),
        "_family": F.when(F.col("has_rule"), M.family_status(F.col("family"), F.col("rule_family"))).otherwise(""),
        "_subtype": F.when(F.col("has_rule"), M.subtype_status(F.col("family"), F.col("subtype"), F.col("rule_family"), F.col("rule_subtype"))).otherwise(""),
        "activity_phase_status": F.coalesce("phase_status", none), "activity_scope_status": F.coalesce("activity_scope_status", none), "activity_scope_source": F.coalesce("scope_source", none),
        "activity_generic": F.coalesce("generic", F.lit(False)), "activity_agrees": F.coalesce("agrees", F.lit(False)), "activity_rrf": F.coalesce("rrf", F.lit(0.0)), "activity_adjusted": F.coalesce("adjusted", F.lit(0.0)),
        "activity_semantic": F.coalesce("activity_semantic", F.lit(0.0)), "query_phase": F.coalesce("query_phase", none), "activity_phase": F.coalesce("activity_phase", none), "sub_type": F.coalesce("sub_type", none),
    })
    df = df.drop("rule_family", "rule_subtype").withColumnsRenamed({"_family": "rule_family", "_subtype": "rule_subtype"})
    df = df.withColumn("gate", Q.gate(Q.rule_block_reasons(), Q.activity_block_reasons()))
    df = D.with_date_range(df, "vt", "anchor", "sub_type", floor)
    outcome = ladder((~F.col("has_rule"), "no_rule"), (F.col("sub_type") == "SKIP", "skip"), (F.col("gate.status") != "generated", F.col("gate.status")), otherwise=D.date_status("anchor"))
    df = df.withColumns({"date_status": outcome, "floor_collapsed": D.floor_collapsed(), "date_default_fc": F.col("vt.fc_lo").isNull() & F.col("fc_recommended").isNotNull()})
    shown = F.col("date_status").isin("generated", "missing_fa", "missing_fc")
    return df.withColumns({c: F.when(shown, F.col(c)) for c in D.RANGE})


def generate_schedule(docs: DataFrame, rules: DataFrame, activities: DataFrame, scorer: PairScorer, embedder: Embedder, judge: Judge | None = None, mapping: DataFrame | None = None, mode: str = "hybrid", floor: Column | None = None) -> DataFrame:
    """One row a document: rule, verdict, activity, resolution, dates, date_status, match records and schedule_quality (status, confidence, reasons).

    Each step is settled before the next, whose plan names it several times.
    Documents that are described alike have one outcome: each description goes
    through the chain once, under a number of its own, and its documents join it.
    mapping: (family, scope, phases), which phases a deliverable of a scope may
    be filed under; scope * stands for any.
    """
    told = [c for c in (*FIELDS, *CANDIDATE) if c in docs.columns]
    keyed = docs.select(F.col("doc_id").cast("long").alias("_doc"), *[F.col(c).cast("string").alias(f"_{c}") for c in told])
    keys = [f"_{c}" for c in told]
    distinct = numbered(keyed.select(*[F.col(k).alias(c) for k, c in zip(keys, told, strict=True)]).distinct(), [F.asc(c) for c in told], "doc_id")
    known = settled(described_rules(rules))
    rows = settled(matched_rules(settled(described(distinct)), known, scorer))
    rows = settled(with_concept(settled(with_verdicts(rows, known, judge)), embedder))
    rows = settled(matched_activities(rows, activities, embedder, mapping, mode))
    found = Q.with_schedule_quality(dated(settled(with_match_records(rows)), floor))
    shown = found.columns
    found = distinct.select("doc_id", *[F.col(c).alias(k) for k, c in zip(keys, told, strict=True)]).join(found, "doc_id")
    out = joined_alike(keyed, found, keys, distinct.count())
    return out.select(*[F.col("_doc").alias(c) if c == "doc_id" else F.col(c) for c in shown])

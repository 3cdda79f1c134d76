"""Shapes of records that the pipelines hand on: match quality, requirements, matches, payloads, templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, text_or_blank
from dossier.functions.text import collapse, fixed, is_yes, key_text, split_list
from dossier.functions.vocabulary import activity_phase, phase_status, scope_keys, scope_status
from dossier.operators.matching import family_status, rule_scope_status, subtype_status

# Activity names that stand for no system; families of evaluation, first hit wins.
GENERIC_ACTIVITIES = ("MECHANICAL DESIGN CRITERIA", "DESIGN CRITERIA")
EVALUATION_FAMILIES = (
    ("p&id", ("P&ID", "P&I", "PIPING INSTRUMENT", "PIPING & INSTRUMENT")),
    ("painting_specification", ("PAINTING SPECIFICATION", "PAINT SPECIFICATION")),
    ("painting", ("PAINTING", "PAINT")),
    ("foundation", ("FOUNDATION", "FDN")),
    ("technical_specification", ("TECHNICAL SPECIFICATION", "SPECIFICATION")),
    ("datasheet", ("DATASHEET", "DATA SHEET")),
    ("system_description", ("SYSTEM DESCRIPTION", "DESCRIPTION")),
    ("design_criteria", ("DESIGN CRITERIA", "CRITERIA")),
    ("design_report", ("DESIGN REPORT", "REPORT")),
    ("design_recommendation", ("DESIGN RECOMMENDATION", "RECOMMENDATION")),
    ("arrangement", ("GENERAL ARRANGEMENT", "ARRANGEMENT", "ARRG")),
    ("outline", ("OUTLINE",)),
    ("procedure", ("PROCEDURE",)),
    ("manual", ("MANUAL", "O&M", "OPERATION AND MAINTENANCE")),
    ("calculation", ("CALCULATION", "CALC")),
    ("study", ("STUDY",)),
    ("curve", ("CURVE",)),
    ("classification", ("CLASSIFICATION",)),
    ("diagram", ("DIAGRAM",)),
    ("configuration", ("CONFIGURATION",)),
    ("list", ("LIST",)),
    ("logic", ("LOGIC",)),
)
SEVERE_FAMILIES = ("painting", "painting_specification", "foundation")
# Titles, types and equipment that a model is not asked about.
UNASKED_EQUIPMENT = ("Plant General", "General Area", "")
UNASKED_TITLES = ("index", "transmittal", "document control", "vendor print", "master document")
UNASKED_TYPES = ("document", "index", "register")
INTENT_KINDS = ("equipment", "systems", "deliverables", "actions", "constraints")
TITLE_CHARS, NUMBER_CHARS = 1200, 800


def joined(keys: Column, separator: str = "|") -> Column:
    return F.array_join(F.coalesce(keys, F.array().cast("array<string>")), separator)


def flag_text(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")


def effective_scope(query: Column, rule: Column) -> Column:
    """Struct (keys, source): the document's own scope wherever it has one, else the rule's."""
    none = F.array().cast("array<string>")
    keys = F.when(F.size(query) > 0, query).when(F.size(rule) > 0, rule).otherwise(none)
    return F.struct(keys.alias("keys"), ladder((F.size(query) > 0, "query"), (F.size(rule) > 0, "rule")).alias("source"))


def generic_activity(name: ColumnOrName, clean_name: ColumnOrName, path: ColumnOrName) -> Column:
    """Whether an activity's words name no system."""
    clean, full = text_or_blank(clean_name), text_or_blank(name)
    shown = F.trim(F.upper(F.when(clean != "", clean).otherwise(full)))
    return shown.isin(*GENERIC_ACTIVITIES) | (F.size(scope_keys(F.concat_ws(" ", clean, full, text_or_blank(path)))) == 0)


def with_activity_quality(df: DataFrame) -> DataFrame:
    """Adds the activity_match_ columns, all as text, to rows of a document and its activity.

    Reads query_phase, query_scopes, rule_scopes, rule_phase, activity_name,
    activity_name_clean, wbs_path, agreement, the two ranks and four scores.
    """
    text = F.concat_ws(" ", text_or_blank("activity_name_clean"), text_or_blank("activity_name"), text_or_blank("wbs_path"))
    df = df.withColumns({"_scope": effective_scope(F.col("query_scopes"), F.col("rule_scopes")), "_of": scope_keys(text), "_phase": activity_phase(text)})
    fields = {
        "query_phase": F.col("query_phase"), "activity_phase": F.col("_phase"), "phase_status": phase_status("query_phase", "_phase", "rule_phase"),
        "query_scope": joined(F.col("query_scopes")), "rule_scope": joined(F.col("rule_scopes")), "effective_scope": joined(F.col("_scope.keys")),
        "scope_source": F.col("_scope.source"), "activity_scope": joined(F.col("_of")), "scope_status": scope_status(F.col("_scope.keys"), F.col("_of")),
        "equipment_agreement": flag_text(F.col("agreement")), "generic_activity": flag_text(generic_activity("activity_name", "activity_name_clean", "wbs_path")),
        **{r: F.when(F.coalesce(F.col(r), F.lit(0)) > 0, F.col(r).cast("string")).otherwise("") for r in ("bm25_rank", "semantic_rank")},
        **{s: fixed(s) for s in ("bm25_score", "semantic_score", "rrf_score", "adjusted_score")},
    }
    return df.withColumns({f"activity_match_{k}": v for k, v in fields.items()}).drop("_scope", "_of", "_phase")


def rule_scope_type(scopes: Column, keyword: ColumnOrName) -> Column:
    """Scoped, specific by its wording alone, or generic."""
    upper = F.upper(text_or_blank(keyword))
    return ladder((F.size(scopes) > 0, "scoped"), (contains_any(upper, (" FOR ", " - ", "_")), "implicit_specific"), otherwise="generic")


def with_rule_quality(df: DataFrame) -> DataFrame:
    """Adds the rule_match_ columns, all as text; a row without a rule has the query's half only.

    Reads rule_id, query_source, query_family, query_subtype, query_scopes,
    rule_family, rule_subtype, rule_scopes, rule_keyword, guard and four scores.
    """
    there = F.col("rule_id").isNotNull()
    if_rule = lambda x: F.when(there, x).otherwise("")
    no_rule = F.when(F.size("query_scopes") == 0, "query_unscoped").otherwise("no_rule")
    fields = {
        **{c: F.col(c) for c in ("query_source", "query_family", "query_subtype")}, **{c: if_rule(F.col(c)) for c in ("rule_family", "rule_subtype")},
        "query_scope": joined(F.array_sort("query_scopes")), "rule_scope": if_rule(joined(F.array_sort("rule_scopes"))), "rule_scope_type": if_rule(rule_scope_type(F.col("rule_scopes"), "rule_keyword")),
        "family_status": if_rule(family_status(F.col("query_family"), F.col("rule_family"))),
        "subtype_status": if_rule(subtype_status(F.col("query_family"), F.col("query_subtype"), F.col("rule_family"), F.col("rule_subtype"))),
        "scope_status": F.when(there, rule_scope_status(F.col("query_scopes"), F.col("rule_scopes"))).otherwise(no_rule),
        "guard_status": ladder((~there, "no_match"), (F.col("guard") == "", "passed"), otherwise="rejected"), "guard_reason": if_rule(F.col("guard")),
        **{s: if_rule(fixed(s)) for s in ("token_score", "semantic_score", "hybrid_score", "final_score")},
    }
    return df.withColumns({f"rule_match_{k}": v for k, v in fields.items()})


def tie_break(candidate_fits: Column, current_fits: Column, candidate_priority: Column, current_priority: Column) -> Column:
    """Whether a tied rule replaces the current one: its item fits where the other's doesn't, or fits alike and is of higher priority."""
    return (candidate_fits & ~current_fits) | ((candidate_fits == current_fits) & (candidate_priority < current_priority))


def semantic_text(*parts: ColumnOrName) -> Column:
    """Non-blank parts as one embedding text: a rule's keyword and item, an activity's name and path."""
    return F.concat_ws(" ", *[F.when(collapse(p) != "", collapse(p)) for p in parts])


def evaluation_family(value: ColumnOrName) -> Column:
    upper = F.upper(text_or_blank(value))
    return ladder(*[(contains_any(upper, words), family) for family, words in EVALUATION_FAMILIES])


def rule_confirmed(scope: ColumnOrName, bucket: ColumnOrName, verdict: ColumnOrName) -> Column:
    return (text_or_blank(scope) == "match") | (text_or_blank(bucket) == "g_safe") | (text_or_blank(verdict) == "generic_ok")


def row_label(number: ColumnOrName, title: ColumnOrName) -> Column:
    n, t = F.trim(text_or_blank(number)), F.trim(text_or_blank(title))
    return F.when(n != "", F.concat(n, F.lit(" | "), t)).otherwise(t)


def run_of_mode(df: DataFrame, mode: str, keys: Sequence[str], values: Mapping[str, str], numbers: Sequence[str] = ()) -> DataFrame:
    """A run's key columns and its value columns named after its mode; absent columns are blank, numbers are cast."""
    there = lambda c: F.col(c) if c in df.columns else F.lit("")
    shown = lambda c: F.trim(there(c).cast("string")).try_cast("double") if c in numbers else F.trim(text_or_blank(there(c).cast("string")))
    return df.select(*[there(k).alias(k) for k in keys], *[shown(c).alias(f"{mode}_{name}") for c, name in values.items()])


def model_payload(df: DataFrame, key: str, fields: Sequence[str], number: str | None, title: str) -> DataFrame:
    """(key, payload): the row as JSON for a model, with long source columns cut."""
    cut = {title: TITLE_CHARS} | ({number: NUMBER_CHARS} if number else {})
    shown = [F.substring(collapse(f), 1, cut[f]).alias(f) if f in cut else collapse(f).alias(f) for f in fields]
    return df.select(key, F.to_json(F.struct(F.col(key), *shown)).alias("payload"))


def asks_model(equipment: ColumnOrName, title: ColumnOrName, kind: ColumnOrName) -> Column:
    """Whether a standard row is specific enough to ask a model about."""
    name, words, of = collapse(equipment), F.lower(text_or_blank(title)), F.lower(collapse(kind))
    return ~name.isin(*UNASKED_EQUIPMENT) & ~contains_any(words, UNASKED_TITLES) & ~of.isin(*UNASKED_TYPES)


def rejections_as_validation(rejections: DataFrame, columns: Sequence[str], kind: str, action: str) -> DataFrame:
    """Rejected model rows (source_title, reason) as validation rows; other columns are blank."""
    known = {"validation_type": F.lit(kind), "severity": F.lit("review"), "standardized_document_title": collapse("source_title"), "reason": collapse("reason"), "recommended_action": F.lit(action)}
    return rejections.select(*[known.get(c, F.lit("")).alias(c) for c in columns])


def variants(canonical: DataFrame, name: str = "canonical", others: str = "variants") -> DataFrame:
    """(variant, canonical) of each spelling, the canonical one too; a later row wins a spelling."""
    return canonical.select(F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(F.col(others), F.array().cast("array<string>"))))).alias("variant"), F.col(name).alias("canonical"))


def prepared_chunks(chunks: DataFrame, abbreviations: Sequence[tuple[str, str]], wrappers: Sequence[str] = (), section: str = "") -> DataFrame:
    """Non-blank chunks with hierarchy (wrapper levels out), known (abbreviations found) and payload (JSON for a model).

    Reads document, chunk_id, page_num, hierarchy_context and text.
    """
    levels = F.filter(F.transform(F.split(text_or_blank("hierarchy_context"), " > "), lambda v: F.trim(v)), lambda v: (v != "") & (v != F.col("document")) & ~v.isin(*wrappers) if wrappers else (v != "") & (v != F.col("document")))
    df = chunks.filter(F.trim(text_or_blank("text")) != "").withColumn("hierarchy", F.replace(F.array_join(levels, " > "), F.lit(","), F.lit(" ")))
    whole = F.concat_ws("\n", "hierarchy", "text")
    named = sorted(((v, c) for v, c in abbreviations if v.lower() != c.lower()), key=lambda p: (-len(p[0]), p[0]))
    found = [F.when(whole.rlike(f"(?i)(?<![A-Za-z0-9])\\Q{v}\\E(?![A-Za-z0-9])"), F.struct(F.lit(v).alias("key"), F.lit(c).alias("value"))) for v, c in named]
    empty = F.array().cast("array<struct<key:string,value:string>>")
    df = df.withColumn("known", F.map_from_entries(F.array_compact(F.array(*found)) if found else empty))
    extra = [F.lit(section).alias("requested_section")] if section else []
    payload = F.to_json(F.struct("document", "chunk_id", F.col("page_num").alias("pages"), F.col("hierarchy").alias("hierarchy_context"), F.col("known").alias("known_abbreviations"), F.col("text").alias("chunk_text"), *extra))
    return df.withColumn("payload", payload)


def candidate_flag(value: ColumnOrName) -> Column:
    """A missing answer counts as a candidate."""
    shown = F.trim(text_or_blank(value))
    return F.when(shown == "", "True").otherwise(shown)


def requirement_records(extracted: DataFrame, depths: int = 5) -> DataFrame:
    """One flat text row an extracted chunk: pages and lists joined, depth_1 to depth_n, flag with its default, what the model said of itself.

    Reads document, chunk_id, page_num, section, hierarchy, depths, keywords,
    candidate, skip_reason and text; section_path, chunk_type, label, confidence,
    needs_review and reason are blank where there are none.
    """
    listed = lambda c: F.array_join(F.filter(F.transform(F.col(c), lambda v: F.trim(v.cast("string"))), lambda v: v != ""), ", ")
    kind = {f.name: f.dataType.typeName() for f in extracted.schema.fields}
    plain = lambda c: F.lit("") if c not in kind else listed(c) if kind[c] == "array" else F.trim(text_or_blank(F.col(c).cast("string")))
    parts = [F.trim(F.coalesce(F.get("depths", F.lit(i)), F.lit(""))).alias(f"depth_{i + 1}") for i in range(depths)]
    return extracted.select(
        "document", plain("chunk_id").alias("chunk_id"), listed("page_num").alias("pages"), *[F.coalesce(plain(c), F.lit("")).alias(c) for c in ("section", "section_path", "chunk_type", "label")], "hierarchy", *parts, listed("keywords").alias("keywords"),
        candidate_flag("candidate").alias("is_candidate"), plain("skip_reason").alias("skip_reason"), *[F.coalesce(plain(c), F.lit("")).alias(c) for c in ("confidence", "needs_review", "reason")], text_or_blank("text").alias("chunk_text"),
    )


def requirement_json(extracted: DataFrame, name: str = "record") -> DataFrame:
    """(document, chunk_id, record): the chunk, what it was asked with, the model's output and check, and the tokens that took, as one JSON text.

    Reads what requirement_records reads, and known (abbreviations), output,
    verification, token_usage and error where there are any; blank ones are left
    out, but for output and verification, which are empty objects.
    """
    there = lambda c: F.col(c) if c in extracted.columns else F.lit(None).cast("string")
    object_of = lambda c: F.coalesce(F.when(F.get_json_object(there(c), "$").isNotNull(), F.parse_json(there(c))), F.parse_json(F.lit("{}"))) if c in extracted.columns else F.parse_json(F.lit("{}"))
    error = F.when(F.trim(text_or_blank(there("error"))) != "", there("error"))
    record = F.struct(
        "document", "chunk_id", F.col("page_num").alias("pages"), "section", there("section_path").alias("section_path"), there("chunk_type").alias("chunk_type"), there("label").alias("label"), F.col("hierarchy").alias("hierarchy_context"),
        there("known").alias("known_abbreviations"), object_of("output").alias("llm_output"), object_of("verification").alias("llm_verification"), there("token_usage").alias("token_usage"), error.alias("error"),
    )
    return extracted.select("document", "chunk_id", F.to_json(record).alias(name))


def rejected_records(extracted: DataFrame, section: str) -> DataFrame:
    """Chunks that a model placed outside the requested section, with what it said."""
    outside = ~is_yes("belongs")
    return extracted.filter(outside).select("document", "chunk_id", F.lit(section).alias("requested_section"), text_or_blank("actual_section").alias("actual_section"), text_or_blank("boundary_reason").alias("reason"))


def match_rows(requirements: DataFrame, matches: DataFrame, key: str, most: int) -> DataFrame:
    """One wide row a requirement: intents joined by ` | `, the number of candidates, Matched_Doc_1 to _n (blank where there are fewer).

    requirements: key, one array a kind of intent; matches: key, rank, display.
    """
    wide = [F.coalesce(F.max(F.when(F.col("rank") == i, F.col("display"))), F.lit("")).alias(f"Matched_Doc_{i}") for i in range(1, most + 1)]
    found = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"), *wide)
    intents = [joined(F.filter(F.col(k), lambda v: F.trim(v) != ""), " | ").alias(f"Requirement_Intent_{k.capitalize()}") for k in INTENT_KINDS if k in requirements.columns]
    out = requirements.select(key, *intents).join(found, key, "left")
    return out.fillna("", [f"Matched_Doc_{i}" for i in range(1, most + 1)]).fillna(0, ["n_candidates"])


def gold_template(generated: DataFrame, truth: DataFrame) -> DataFrame:
    """One row to be labelled for each positive chunk of a generated document that is judged right.

    generated: doc_id, title, exact_hit, positive_chunks (text), rule_keyword, submission_type, date_status; truth: chunk_id, doc_id, section.
    """
    hits = generated.filter(F.coalesce("exact_hit", F.lit(False))).withColumn("chunk_id", F.explode(split_list("positive_chunks", "[;|,]")))
    both = hits.join(truth.select("chunk_id", "doc_id", "section"), ["chunk_id", "doc_id"], "left")
    blank = [F.lit("").alias(c) for c in ("expected_activity_id", "expected_activity_phase", "expected_anchor_type", "notes")]
    return both.select(
        text_or_blank("section").alias("section"), "chunk_id", "doc_id", text_or_blank("title").alias("title"), text_or_blank("rule_keyword").alias("expected_rule_keyword"),
        text_or_blank("submission_type").alias("expected_submission_type"), text_or_blank("date_status").alias("expected_date_status"), *blank,
    )


def sliced_scores(review: DataFrame, generated: DataFrame, keys: Sequence[str], flag: str, answers: Sequence[str]) -> DataFrame:
    """(slice, n, and for each answer its yes count and accuracy) of reviewed rows inside and outside a generated set."""
    inside = generated.filter(flag).select(*keys).distinct().withColumn("_in", F.lit(True))
    rows = review.join(inside, list(keys), "left").withColumn("slice", F.when(F.coalesce("_in", F.lit(False)), flag).otherwise(f"non_{flag}"))
    said = {a: F.lower(F.trim(text_or_blank(a))) for a in answers}
    yes = {a: F.count_if(v == "yes") for a, v in said.items()}
    judged = {a: F.count_if(v.isin("yes", "no")) for a, v in said.items()}
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *[yes[a].alias(f"{a}_yes") for a in answers], *[F.when(judged[a] > 0, F.round(yes[a] / judged[a], 6)).alias(f"{a}_accuracy") for a in answers])


def has_phrase(text: ColumnOrName, phrases: Sequence[str]) -> Column:
    """Whether normalised text holds any phrase: single words as whole words, longer phrases anywhere."""
    value, out = key_text(text), F.lit(False)
    for phrase in phrases:
        plain = key_text(F.lit(phrase))
        word = plain.rlike("^[A-Z0-9]+$")
        whole = F.contains(F.concat(F.lit(" "), value, F.lit(" ")), F.concat(F.lit(" "), plain, F.lit(" ")))
        out = out | ((plain != "") & F.when(word, whole).otherwise(F.contains(value, plain)))
    return out


def schedule_metadata(rows: DataFrame, kind: str = "row_type") -> DataFrame:
    """(field, value): clean row count and rows of each type."""
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.col(kind), F.lit(" rows")).alias("field"), "value")
    return counts.unionByName(rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit("Clean row count").alias("field"), "value"))


def run_rankings(runs: DataFrame, section: ColumnOrName = "section") -> tuple[DataFrame, DataFrame]:
    """(query_id, list, rank, doc_id) of matched and retrieved ids, and one row (output_limit, retrieval_limit, complete).

    runs: section, chunk_id, matched_ids and retrieval_ids (`|`-joined, null where the run kept none). Blank chunks are left out; an id counts once.
    """
    ids = lambda c: F.array_distinct(split_list(c, "\\|"))
    rows = runs.filter(F.trim(text_or_blank("chunk_id")) != "").withColumns({"query_id": F.concat(col(section).cast("string"), F.lit(":"), F.trim("chunk_id")), "_m": ids("matched_ids"), "_r": ids("retrieval_ids")})
    listed = rows.select("query_id", F.explode(F.array(F.struct(F.lit("matched").alias("list"), F.col("_m").alias("ids")), F.struct(F.lit("retrieved").alias("list"), F.col("_r").alias("ids")))).alias("x"))
    ranks = listed.select("query_id", "x.list", F.posexplode("x.ids").alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)
    limits = rows.agg(F.max(F.size("_m")).alias("output_limit"), F.max(F.size("_r")).alias("retrieval_limit"), F.coalesce(F.bool_and(F.col("retrieval_ids").isNotNull()), F.lit(True)).alias("complete"))
    return ranks, limits

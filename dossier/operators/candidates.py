"""Candidate display strings, keys and selection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, reasons, text_or_blank
from dossier.functions.text import collapse
from dossier.functions.vocabulary import looks_like_code

# Score labels from strongest to weakest, plant-level wording.
SCORE_LABELS = ("Semantic", "Vector", "CrossEncoder")
PLANT_WORDS = ("PLANT OVERALL", "PLANT PERFORMANCE", "PLANT GENERAL", "OVERALL PLANT", "OVERALL PROTECTION", "OVERALL SYSTEM", "SITE")
PLANT_DELIVERABLES = ("HAZARDOUS AREA CLASSIFICATION", "AREA CLASSIFICATION", "PERFORMANCE CORRECTION CURVE", "PERFORMANCE CURVE", "CAPABILITY CURVE", "CORRECTION CURVE")
TOP_N = 20
RANK_BONUS = 0.003


def display_string(project: ColumnOrName, number: ColumnOrName, title: ColumnOrName, **scores: ColumnOrName) -> Column:
    """`[project] number - title (Label: 0.1234 / ...)`; blank parts and null scores are left out."""
    shown = F.concat_ws(" / ", *[F.when(col(v).isNotNull(), F.concat(F.lit(f"{k}: "), F.format_string("%.4f", col(v).cast("double")))) for k, v in scores.items()])
    head = F.when(text_or_blank(project) != "", F.concat(F.lit("["), col(project), F.lit("] "))).otherwise("")
    code = F.when(text_or_blank(number) != "", F.concat(col(number), F.lit(" - "))).otherwise("")
    return F.concat(head, code, text_or_blank(title), F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise(""))


def display_score(raw: ColumnOrName) -> Column:
    """The strongest score named in the string; CrossEncoder only where positive; else 0."""

    def named(label: str) -> Column:
        return F.regexp_extract(col(raw), f"{label}: *(-?[0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")

    cross = named("CrossEncoder")
    return F.coalesce(named("Semantic"), named("Vector"), F.when(cross > 0, cross), F.lit(0.0))


def parse_display(raw: ColumnOrName) -> Column:
    """Struct (score, document_no, equipment, title) of a display string."""
    text = F.trim(F.regexp_replace(text_or_blank(raw), "\\s*\\([^)]*(?:CrossEncoder|Vector|BM25|Semantic|RRF)[^)]*\\)\\s*$", ""))
    text = F.regexp_replace(text, "^\\[.+?\\]\\s*", "")
    numbered = "^([A-Za-z0-9][A-Za-z0-9_./-]*[0-9][A-Za-z0-9_./-]*)\\s+-\\s+(.+)$"
    number = F.when(text.rlike(numbered), F.regexp_extract(text, numbered, 1)).otherwise("")
    rest = F.when(text.rlike(numbered), F.regexp_extract(text, numbered, 2)).otherwise(text)
    dashed, scored = rest.contains(" - "), rest.contains("_")
    equipment = ladder((dashed, F.trim(F.substring_index(rest, " - ", 1))), (scored, F.trim(F.substring_index(rest, "_", 1))))
    title = ladder((dashed, F.trim(F.regexp_replace(rest, "^.*? - ", ""))), (scored, F.trim(F.replace(rest, F.lit("_"), F.lit(" ")))), otherwise=rest)
    return F.struct(display_score(raw).alias("score"), number.alias("document_no"), equipment.alias("equipment"), title.alias("title"))


def plant_level(title: ColumnOrName, deliverable: ColumnOrName) -> Column:
    """Whether a candidate stands for the whole plant rather than for one scope."""
    t, d = F.upper(collapse(title)), F.upper(collapse(deliverable))
    text = F.concat_ws(" ", t, d)
    own = (d.contains("CLASSIFICATION") & contains_any(t, ("PLANT", "OVERALL", "SITE"))) | (d.contains("CURVE") & contains_any(t, ("PERFORMANCE", "CAPABILITY")))
    return (t != "") & (d != "") & (contains_any(text, PLANT_WORDS) | contains_any(text, PLANT_DELIVERABLES) | own)


def candidate_quality(title: ColumnOrName, scope: ColumnOrName, deliverable: ColumnOrName, equipment: ColumnOrName) -> Column:
    """Struct (status, issues)."""
    blank = lambda x: F.trim(text_or_blank(x)) == ""
    found = reasons((blank(title), "missing_title"), (blank(scope) & ~plant_level(title, deliverable), "missing_scope"), (blank(deliverable), "missing_deliverable"), (looks_like_code(equipment), "equipment_looks_like_document_code"))
    return F.struct(F.when(F.size(found) == 0, "accepted").otherwise("needs_review").alias("status"), F.array_join(found, ";").alias("issues"))


def selection_score(score: ColumnOrName, best_rank: ColumnOrName, deliverable: ColumnOrName, scope: ColumnOrName, status: ColumnOrName, alignment: ColumnOrName) -> Column:
    filled = lambda x: F.trim(text_or_blank(x)) != ""
    bonus = F.greatest(F.lit(0), TOP_N + 1 - F.coalesce(col(best_rank), F.lit(99))) * RANK_BONUS
    complete = F.when(filled(deliverable), 0.015).otherwise(0.0) + F.when(filled(scope), 0.015).otherwise(0.0) + F.when(col(status) == "accepted", 0.010).otherwise(0.0)
    return F.coalesce(col(score).cast("double"), F.lit(0.0)) + bonus + complete + F.coalesce(col(alignment).cast("double"), F.lit(0.0))


def needs_model(df: DataFrame) -> DataFrame:
    """Candidates that rules alone couldn't place."""
    scope = F.concat_ws("", "equipment", "system", "building")
    return df.filter((F.trim(text_or_blank("deliverable")) == "") | (F.trim(scope) == "") | looks_like_code("equipment"))

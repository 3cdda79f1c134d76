"""Audits of generated schedules and lists against judged pairs, and the inference ladders of the standard list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, text_or_blank
from dossier.functions.text import collapse

# Scope tokens of the rule vocabulary, and words that identify nothing.
RULE_SCOPES = ("acc", "bfp", "bop", "bsedg", "ccr", "ccwp", "cep", "dcs", "fgp", "gt", "gtg", "hrsg", "leb", "piperack", "pump", "st", "stg", "tank")
RULE_SCOPE_PHRASES = (
    ("acc", "ACC"), ("acc", "AIR COOLED CONDENSER"), ("acc", "COND AIR EXT"),
    ("ccr", "CCR"), ("ccr", "CENTRAL CONTROL BUILDING"), ("ccr", "CONTROL ROOM"),
    ("hrsg", "HRSG"), ("hrsg", "HEAT RECOVERY STEAM GENERATOR"),
    ("gtg", "GTG"), ("gtg", "GT"), ("gtg", "GAS TURBINE GENERATOR"), ("gtg", "GAS TURBINE"),
    ("leb", "LEB"), ("leb", "LOCAL ELECTRICAL BUILDING"),
    ("piperack", "PIPE RACK"), ("piperack", "PIPERACK"),
    ("pump", "PUMP"),
    ("stg", "STG"), ("stg", "ST"), ("stg", "STEAM TURBINE GENERATOR"), ("stg", "STEAM TURBINE"),
    ("tank", "TANK"), ("tank", "TANKS"),
    ("dcs", "DCS"), ("dcs", "DISTRIBUTED CONTROL SYSTEM"),
    ("cems", "CEMS"), ("cems", "CONTINUOUS EMISSION MONITORING"),
    ("wts", "WATER TREATMENT"), ("wts", "WTS"),
    ("reserve_boiler", "RESERVE BOILER"), ("reserve_boiler", "AUX BOILER"), ("reserve_boiler", "AUXILIARY BOILER"),
    ("bop", "BOP"), ("bop", "BALANCE OF PLANT"),
    ("fgp", "FGP"), ("fgp", "FUEL GAS PACKAGE"), ("fgp", "FUEL GAS"),
    ("fire_protection", "FIRE ALARM"), ("fire_protection", "FIRE FIGHTING"), ("fire_protection", "FIRE WATER"), ("fire_protection", "FIRE BRIGADE"), ("fire_protection", "FIRE HYDRANT"), ("fire_protection", "SPRINKLER"), ("fire_protection", "STAND PIPE"), ("fire_protection", "STANDPIPE"), ("fire_protection", "DELUGE"), ("fire_protection", "CLEAN AGENT"), ("fire_protection", "FM200"), ("fire_protection", "FM 200"),
    ("drainage", "DRAINAGE"), ("drainage", "STORMWATER"), ("drainage", "STORM WATER"), ("drainage", "SEWAGE"), ("drainage", "SANITARY"),
    ("cooling_tower", "COOLING TOWER"),
)
DOC_TYPES = (("Data Sheet", ("DATA SHEET", "DATASHEET")), ("Drawing", ("DRAWING", "LAYOUT", "ARRANGEMENT", "P&ID", "DIAGRAM")), ("Report", ("REPORT", "STUDY")), ("Specification", ("SPECIFICATION",)), ("List", ("LIST", "SCHEDULE")), ("Calculation", ("CALCULATION",)))
DISCIPLINES = (("Electrical", ("CABLE", "UPS", "ELECTRICAL", "LIGHTING")), ("Instrument", ("INSTRUMENT", "CONTROL", "DCS", "P&ID")), ("Civil", ("FOUNDATION", "BUILDING", "CIVIL", "ROAD")), ("Fire", ("FIRE",)), ("Mechanical", ("PUMP", "TURBINE", "BOILER", "WATER", "GT")))


def _spaced(text: ColumnOrName) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(text_or_blank(text)), "[^A-Z0-9]+", " ")), F.lit(" "))


def rule_scope_keys(text: ColumnOrName) -> Column:
    """Single words as whole words and longer phrases anywhere in normalised text, and tokens that are scope words themselves; sorted."""
    spaced = _spaced(text)
    phrases = F.array_compact(F.array(*[F.when(spaced.contains(p if " " in p else f" {p} "), F.lit(k)) for k, p in RULE_SCOPE_PHRASES]))
    tokens = F.array_intersect(F.split(F.lower(F.trim(spaced)), " "), F.array(*[F.lit(t) for t in RULE_SCOPES]))
    return F.array_sort(F.array_union(phrases, tokens))


def free_tokens(text: ColumnOrName, generic: Sequence[str] = ()) -> Column:
    """Words of three letters or more that are neither numbers, scopes nor generic; sorted."""
    found = F.array_distinct(F.split(F.lower(F.trim(_spaced(text))), " "))
    known = F.array(*[F.lit(t) for t in (*RULE_SCOPES, *generic)])
    return F.array_sort(F.filter(F.array_except(found, known), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$")))


def standard_facets(title: ColumnOrName) -> Column:
    """Struct (doc_type, discipline, scope_type, subject) that a title implies."""
    upper = F.upper(text_or_blank(title))
    pick = lambda table, otherwise: ladder(*[(contains_any(upper, ws), k) for k, ws in table], otherwise=otherwise)
    doc_type = pick(DOC_TYPES, "General")
    scope = F.when(doc_type.isin("Data Sheet") | contains_any(upper, ("VENDOR", "SHOP DRAWING")), "Vendor").otherwise("EPC")
    return F.struct(doc_type.alias("doc_type"), pick(DISCIPLINES, "General").alias("discipline"), scope.alias("scope_type"), F.coalesce(F.when(collapse(title) != "", collapse(title)), F.lit("Untitled")).alias("subject"))


def first_filled(*values: ColumnOrName, otherwise: str = "General") -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(text_or_blank(v)) != "", F.trim(col(v))) for v in values], F.lit(otherwise))


def exact_hits(generated: DataFrame, qrels: DataFrame, row: str, chunks: str, doc: str, least: int = 3) -> DataFrame:
    """(row, exact_hit): whether any of a row's chunks is judged relevant for its document."""
    pairs = generated.select(row, F.explode(chunks).alias("chunk_id"), F.col(doc).alias("doc_id"))
    good = qrels.filter(F.col("relevance") >= least).select("chunk_id", "doc_id").distinct().withColumn("_h", F.lit(True))
    return pairs.join(good, ["chunk_id", "doc_id"], "left").groupBy(row).agg(F.bool_or(F.coalesce("_h", F.lit(False))).alias("exact_hit"))


def missing_truth(qrels: DataFrame, generated: DataFrame, least: int = 3) -> DataFrame:
    """Judged positives that no generated row carries."""
    return qrels.filter(F.col("relevance") >= least).select("chunk_id", "doc_id").distinct().join(generated.select("chunk_id", "doc_id").distinct(), ["chunk_id", "doc_id"], "left_anti")


def best_raw_match(matches: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, rank, score): the best rank, with the first score there is of semantic, fused and pair score."""
    score = F.coalesce("semantic_score", "rrf_score", "pair_score", F.lit(0.0))
    return matches.groupBy("chunk_id", "doc_id").agg(F.min("rank").alias("rank"), F.min_by(score, "rank").alias("score"))


def schedule_summary(rows: DataFrame) -> DataFrame:
    """One row: counts and rates of exact hits and usable rows (exact_hit, usable, date_status)."""
    n = F.count(F.lit(1))
    rate = lambda c: F.when(n > 0, F.round(F.count_if(c) / n, 6))
    return rows.agg(n.alias("n"), F.count_if("exact_hit").alias("hits"), rate(F.col("exact_hit")).alias("hit_rate"), F.count_if("usable").alias("usable"), rate(F.col("usable")).alias("usable_rate"), F.count_if(F.col("date_status") == "generated").alias("generated"))


def output_checks(rows: DataFrame, title: str, group: str, scope: str, scopes: Sequence[str]) -> DataFrame:
    """(check, n): blank titles, repeated titles in a group, unknown scopes, qualifiers left in titles."""
    from pyspark.sql import Window

    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group, title)))
    one = rows.agg(
        F.count_if(F.trim(text_or_blank(title)) == "").alias("blank_title"), F.count_if(F.col("_n") > 1).alias("duplicate_title"), F.count_if(~F.col(scope).isin(*scopes)).alias("unknown_scope"),
        F.count_if(F.col(title).rlike("(?i)\\b(?:block|unit|train)\\s*#?[0-9]+\\b")).alias("qualifier_left"),
    )
    names = ("blank_title", "duplicate_title", "unknown_scope", "qualifier_left")
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")

"""Register wording, scopes and joins that the pipelines share."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, ranked, text_or_blank
from dossier.functions.text import collapse, slug
from dossier.operators.listing import joined_values, with_group
from dossier.functions.vocabulary import DELIVERABLE_WORDS, RULE_WORDS, Aliases, alias_pattern, deliverable_type, extract_deliverable, normalize_deliverable  # noqa: F401

GENERIC_DELIVERABLES = ("", "SPECIFICATION", "TECHNICAL SPECIFICATION", "TECHNICAL SPECIFICATIONS")
PAINTING_WORDS = ("PAINTING SPECIFICATION", "PAINT SPECIFICATION")
GENERIC_DATA = ("", "DATA", "OPERATIONAL DATA", "PERFORMANCE DATA", "CURVES", "CURVE")
CURVE_WORDS = (
    "GENERATOR CAPABILITY CURVES AND DATA", "CAPABILITY CURVES AND DATA", "CAPABILITY CURVES", "PERFORMANCE DATA AND CURVES", "PERFORMANCE CURVES", "PERFORMANCE CURVE", "PERFORMANCE DATA", "CURVES", "CURVE",
)
# Equipment by raw or short name, equipment that a title names (most specific first), and the short forms of rules.
EQUIPMENT_RAW = {
    "GTG": "Gas Turbine Generator", "GT": "Gas Turbine Generator", "HRSG": "Heat Recovery Steam Generator", "STG": "Steam Turbine & Generator",
    "ST": "Steam Turbine", "ACC": "Air Cooled Condenser", "BOP": "Balance of Plant", "DCS": "DCS", "GIS": "GIS", "CEP": "Condensate Extraction Pump",
    "BFP": "Boiler Feed Pump", "BOP PIPING": "BOP Piping", "CCWP": "Cooling Water Package", "FGP": "Fuel Gas Package",
    "BSEDG": "Blackstart Emergency Diesel Generator", "AIR COOLED CONDENSER": "Air Cooled Condenser",
    "AIR COOLED CONDENSER FOUNDATION": "Air Cooled Condenser", "HEAT RECOVERY STEAM GENERATOR": "Heat Recovery Steam Generator",
    "HEAT RECOVERY STEAM GENERATOR FOUNDATION": "Heat Recovery Steam Generator", "GAS TURBINE GENERATOR": "Gas Turbine Generator",
    "GAS TURBINE": "Gas Turbine Generator", "STEAM TURBINE & GENERATOR": "Steam Turbine & Generator",
    "STEAM TURBINE GENERATOR": "Steam Turbine & Generator", "STEAM TURBINE": "Steam Turbine",
    "CONDENSATE EXTRACTION PUMP": "Condensate Extraction Pump", "CONDENSER VACUUM PUMP": "Condenser Vacuum Pump",
    "CEP & CONDENSER FOUNDATION": "Steam Turbine", "CONDENSER TUBE CLEANING SYSTEM": "Steam Turbine", "BOILER FEED PUMP": "Boiler Feed Pump",
    "FIN FAN COOLER": "Fin Fan Cooler", "FIN FAN": "Fin Fan Cooler", "AIR COMPRESSOR": "Air Compressor", "FUEL GAS SUPPLY SYSTEM": "Fuel Gas Package",
    "FUEL GAS STATION FOUNDATION": "Fuel Gas Package", "WTP": "Water Treatment Plant", "WATER TREATMENT PLANT": "Water Treatment Plant",
    "WASTE WATER TREATMENT PLANT": "Water Treatment Plant", "WASTE WATER TREATMENT": "Water Treatment Plant",
    "WATER TREATMENT": "Water Treatment Plant", "ULSD STORAGE TANK FOUNDATION": "Fuel Oil System",
    "FUEL OIL FALSE START STORAGE TANK PIT": "Fuel Oil System", "HVAC SYSTEM": "HVAC",
}
EQUIPMENT_SCAN = (
    ("HEAT RECOVERY STEAM GENERATOR", "Heat Recovery Steam Generator"), ("AIR COOLED CONDENSER", "Air Cooled Condenser"),
    ("GAS TURBINE GENERATOR", "Gas Turbine Generator"), ("STEAM TURBINE & GENERATOR", "Steam Turbine & Generator"),
    ("STEAM TURBINE GENERATOR", "Steam Turbine & Generator"), ("CONDENSATE EXTRACTION PUMP", "Condensate Extraction Pump"),
    ("CONDENSER VACUUM PUMP", "Condenser Vacuum Pump"), ("WATER TREATMENT PLANT", "Water Treatment Plant"),
    ("WASTE WATER TREATMENT", "Water Treatment Plant"), ("BOILER FEED PUMP", "Boiler Feed Pump"), ("FIN FAN COOLER", "Fin Fan Cooler"),
    ("AIR COMPRESSOR", "Air Compressor"), ("STEAM TURBINE", "Steam Turbine"), ("GAS TURBINE", "Gas Turbine Generator"),
    ("FUEL OIL", "Fuel Oil System"), ("FUEL GAS", "Fuel Gas Package"), ("HRSG", "Heat Recovery Steam Generator"), ("GTG", "Gas Turbine Generator"),
    ("STG", "Steam Turbine & Generator"), ("CEP", "Condensate Extraction Pump"), ("BFP", "Boiler Feed Pump"), ("GIS", "GIS"), ("DCS", "DCS"),
    ("ACC", "Air Cooled Condenser"), ("BOP", "Balance of Plant"),
)
EQUIPMENT_SHORT = {
    "Heat Recovery Steam Generator": "HRSG", "Gas Turbine Generator": "GTG", "Steam Turbine & Generator": "STG", "Steam Turbine": "STG",
    "Air Cooled Condenser": "ACC", "Condensate Extraction Pump": "CEP", "Boiler Feed Pump": "BFP", "Fuel Gas Package": "FGP",
    "Balance of Plant": "BOP", "Cooling Water Package": "CCWP", "Blackstart Emergency Diesel Generator": "BSEDG",
}
# The five names that the SQL of equipment_words holds; equipment_names has the whole tables.
EQUIPMENT_NAMES = {"HRSG": "HEAT RECOVERY STEAM GENERATOR", "GTG": "GAS TURBINE GENERATOR", "STG": "STEAM TURBINE GENERATOR", "ACC": "AIR COOLED CONDENSER", "BFP": "BOILER FEED PUMP"}
# What a requirement can ask for.
INTENT: dict[str, Aliases] = {
    "equipment": (
        ("Air Cooled Condenser", ("ACC", "AIR COOLED CONDENSER", "AIR-COOLED CONDENSER")),
        ("Heat Recovery Steam Generator", ("HRSG", "HEAT RECOVERY STEAM GENERATOR")),
        ("Gas Turbine Generator", ("GTG", "GAS TURBINE GENERATOR", "GAS TURBINE")),
        ("Steam Turbine Generator", ("STG", "STEAM TURBINE GENERATOR", "STEAM TURBINE")),
        ("Distributed Control System", ("DCS", "DISTRIBUTED CONTROL SYSTEM")),
        ("Continuous Emission Monitoring System", ("CEMS", "CONTINUOUS EMISSION MONITORING")),
        ("Water Treatment System", ("WATER TREATMENT", "WASTE WATER", "WASTEWATER", "SEWAGE TREATMENT")),
    ),
    "systems": (
        ("Hazardous Area", ("HAZARDOUS AREA", "AREA CLASSIFICATION")),
        ("Performance", ("PERFORMANCE", "GUARANTEE", "GUARANTEED")),
        ("Emission Monitoring", ("CEMS", "EMISSION MONITORING")),
        ("Power Metering", ("POWER METERING", "METERING SYSTEM")),
        ("Waste Water Treatment", ("WASTE WATER", "WASTEWATER", "SEWAGE TREATMENT")),
    ),
    "deliverables": (
        ("Hazardous Area Classification", ("HAZARDOUS AREA CLASSIFICATION", "AREA CLASSIFICATION")),
        ("Performance Correction Curve", ("PERFORMANCE CORRECTION CURVE",)),
        ("Performance Curve", ("PERFORMANCE CURVE", "CAPABILITY CURVE", "CORRECTION CURVE")),
        ("Degradation Curve", ("DEGRADATION CURVE", "DEGRADATION FACTOR")),
        ("Technical Specification", ("TECHNICAL SPECIFICATION", "TECHNICAL SPECIFICATIONS", "SPECIFICATION")),
        ("P&ID", ("P&ID", "P&I DIAGRAM", "PIPING AND INSTRUMENT", "PIPING & INSTRUMENT")),
        ("System Description", ("SYSTEM DESCRIPTION",)),
        ("Functional Design Specification", ("FUNCTIONAL DESIGN SPECIFICATION", "FDS")),
        ("Design Report", ("DESIGN REPORT",)),
        ("CFD Report", ("CFD REPORT",)),
        ("Report", ("REPORT",)),
        ("Process Flow Diagram", ("PROCESS FLOW DIAGRAM", "PFD")),
        ("Control Logic Diagram", ("CONTROL LOGIC DIAGRAM", "LOGIC DIAGRAM")),
        ("Power Distribution Diagram", ("POWER DISTRIBUTION",)),
        ("Diagram", ("DIAGRAM",)),
        ("Datasheet & Drawings", ("DATASHEET & DRAWING", "DATASHEET AND DRAWING", "DATA SHEET & DRAWING")),
        ("Instrument List", ("INSTRUMENT LIST",)),
        ("Equipment List", ("EQUIPMENT LIST",)),
        ("List", ("LIST",)),
        ("General Arrangement", ("GENERAL ARRANGEMENT", "ARRANGEMENT")),
        ("Outline Drawing", ("OUTLINE DRAWING", "OUTLINE")),
        ("Calculation", ("CALCULATION", "CALCULATIONS")),
        ("Procedure", ("PROCEDURE",)),
        ("Manual", ("MANUAL", "O&M")),
    ),
    "actions": (
        ("submit", ("SUBMIT", "SUBMISSION", "DELIVER", "PROVIDE", "FURNISH")),
        ("prepare", ("PREPARE", "ISSUE", "DEVELOP")),
        ("calculate", ("CALCULATE", "CALCULATION", "DETERMINE")),
        ("guarantee", ("GUARANTEE", "GUARANTEED", "WARRANT")),
        ("review", ("REVIEW", "APPROVAL", "APPROVE")),
    ),
    "constraints": (
        ("post-COD", ("POST-COD", "POST COD", "AFTER COD")),
        ("long-term", ("LONG TERM", "LONG-TERM")),
        ("as-built", ("AS BUILT", "AS-BUILT")),
        ("block-specific", ("BLOCK #", "BLOCK NO", "UNIT #", "UNIT NO")),
        ("plant overall", ("PLANT OVERALL", "OVERALL PLANT", "WHOLE SITE", "ENTIRE PLANT")),
    ),
}


def refine_deliverable(value: ColumnOrName, title: ColumnOrName) -> Column:
    """A generic value gives way to a specific painting specification or curve that the title names."""
    found, now = extract_deliverable(title), F.upper(F.trim(text_or_blank(value)))
    painting = now.isin(*GENERIC_DELIVERABLES) & found.isin(*PAINTING_WORDS)
    curve = now.isin(*GENERIC_DATA) & found.isin(*CURVE_WORDS)
    return F.when(painting | curve, found).otherwise(F.trim(text_or_blank(value)))


def normalize_equipment(value: ColumnOrName) -> Column:
    """The canonical name of a raw or short one; other values without their parentheses."""
    raw = F.trim(text_or_blank(value))
    cleaned = F.trim(F.regexp_replace(raw, "\\(.*?\\)", ""))
    return F.coalesce(F.create_map(*[F.lit(x) for p in EQUIPMENT_RAW.items() for x in p])[F.upper(cleaned)], F.when(cleaned != "", cleaned), raw)


def equipment_in(title: ColumnOrName) -> Column:
    """The canonical name of the first known equipment in a title."""
    upper = F.upper(text_or_blank(title))
    return ladder(*[(upper.contains(word), full) for word, full in EQUIPMENT_SCAN])


def equipment_short(name: ColumnOrName) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in EQUIPMENT_SHORT.items() for x in p])[col(name)], col(name))


def named_equipment(title: ColumnOrName, names: dict[str, str]) -> Column:
    """The first of the names (full by short) that a title has in full or short."""
    upper = F.concat(F.lit(" "), F.regexp_replace(F.upper(text_or_blank(title)), "[^A-Z0-9]+", " "), F.lit(" "))
    return ladder(*[(upper.contains(f" {short} ") | upper.contains(full), full) for short, full in names.items()])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Adds canonical_equipment, _system, _building, _family, _subtype and _scope_text from the raw facets."""
    equipment = F.when(F.trim(text_or_blank("equipment")) != "", normalize_equipment("equipment")).otherwise(equipment_in("title"))
    df = df.withColumns({"canonical_equipment": equipment, "canonical_system": F.upper(collapse("system")), "canonical_building": F.upper(collapse("building")), "_refined": refine_deliverable("deliverable", "title")})
    df = df.withColumn("_kind", deliverable_type("_refined", "title")).drop("_refined")
    df = df.withColumns({"canonical_family": F.col("_kind.family"), "canonical_subtype": F.col("_kind.subtype")}).drop("_kind")
    return df.withColumn("canonical_scope_text", F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("canonical_equipment", "canonical_system", "canonical_building")]))


def query_scope(family: ColumnOrName, equipment: ColumnOrName, system: ColumnOrName, building: ColumnOrName, title: ColumnOrName) -> Column:
    """Struct (text, source): the first non-blank field in the order that the deliverable's bucket asks for."""
    fields = {"equipment": text_or_blank(equipment), "system": text_or_blank(system), "building": text_or_blank(building), "title": text_or_blank(title)}
    orders = {"system": ("system", "equipment", "title", "building"), "civil": ("building", "equipment", "system", "title"), "equipment": ("equipment", "system", "title", "building"), "default": ("equipment", "system", "building", "title")}
    bucket = ladder((col(family).isin("diagram", "description", "criteria"), "system"), (col(family).isin("calculation", "plan"), "civil"), (col(family).isin("datasheet", "specification", "curve", "manual"), "equipment"), otherwise="default")
    pick = lambda names: F.coalesce(*[F.when(F.trim(fields[n]) != "", F.struct(F.trim(fields[n]).alias("text"), F.lit(n).alias("source"))) for n in names], F.struct(F.lit("").alias("text"), F.lit("none").alias("source")))
    out = None
    for name, order in orders.items():
        out = F.when(bucket == name, pick(order)) if out is None else out.when(bucket == name, pick(order))
    return out


def rule_query(deliverable: ColumnOrName, scope: ColumnOrName) -> Column:
    """`deliverable for scope`, or whichever is there."""
    d, s = F.trim(text_or_blank(deliverable)), F.trim(text_or_blank(scope))
    return F.when((d != "") & (s != ""), F.concat(d, F.lit(" for "), s)).otherwise(F.concat(d, s))


def intent_keys(text: ColumnOrName, table: Aliases) -> Column:
    """Sorted keys of every entry with an alias in the text: single words as whole words, longer aliases anywhere."""
    value = F.trim(F.regexp_replace(F.upper(text_or_blank(text)), "[^A-Z0-9&#+/-]+", " "))
    word = lambda a: re.fullmatch("[A-Z0-9&]+", a) is not None
    has = lambda aliases: contains_any(value, [a for a in aliases if not word(a)]) | (value.rlike(alias_pattern([a for a in aliases if word(a)])) if any(map(word, aliases)) else F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(has(aliases), F.lit(key)) for key, aliases in table])))


def requirement_intent(text: ColumnOrName) -> Column:
    """Struct of sorted keys for each kind of intent."""
    return F.struct(*[intent_keys(text, table).alias(kind) for kind, table in INTENT.items()])


def strip_qualifiers(text: ColumnOrName, projects: Sequence[str] = ()) -> Column:
    """Titles without block, unit and project qualifiers."""
    out = F.regexp_replace(text_or_blank(text), "(?i)\\(?\\bfor\\s+(?:block|unit|train)\\s*#?\\d+\\)?|\\b(?:block|unit|train)\\s*#?\\d+\\b", " ")
    for name in projects:
        out = F.regexp_replace(out, f"(?i)\\b\\Q{name}\\E\\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "\\s+", " "), "^[-_ ]+|[-_ ]+$", ""))


def group_of(scope: ColumnOrName, title: ColumnOrName, packages: Sequence[tuple[str, str]]) -> Column:
    """Vendor rows by the first package marker of their title, EPC rows as EPC; others have no group."""
    marked = ladder(*[(F.upper(text_or_blank(title)).rlike(pattern), F.concat(F.lit("Vendor: "), F.lit(name))) for name, pattern in packages], otherwise=F.lit(None).cast("string"))
    return F.when(col(scope) == "Vendor", marked).when(col(scope) == "EPC", F.lit("EPC"))


def allowed_value(text: ColumnOrName, aliases: Sequence[tuple[str, str]], otherwise: str = "") -> Column:
    """The canonical value whose longest alias is in the text as whole words."""
    upper = F.upper(text_or_blank(text))
    order = sorted(aliases, key=lambda a: (-len(a[0]), a[0]))
    return ladder(*[(upper.rlike(f"(?<![A-Z0-9])\\Q{alias.upper()}\\E(?![A-Z0-9])"), value) for alias, value in order], otherwise=otherwise)


def scope_name(path: ColumnOrName) -> Column:
    """A file's stem without extension and run suffixes."""
    stem = F.regexp_replace(F.element_at(F.split(text_or_blank(path), "/"), -1), "\\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(stem, "(?i)_(?:mdl|itb|classified|output)$", "")


def hierarchy(path: ColumnOrName) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text_or_blank(path), ">"), lambda v: F.trim(v)), lambda v: v != ""), " > ")


# Joins -------------------------------------------------------------------


def resolve_doc_ids(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], doc_id: str = "doc_id", position: str = "position") -> DataFrame:
    """rows with the doc_id of the first candidate of their normalised key."""
    norm = lambda df: F.concat_ws("|", *[slug(c) for c in keys])
    first = candidates.withColumn("_k", norm(candidates)).withColumn("_r", ranked(["_k"], F.asc(position))).filter("_r = 1").select("_k", F.col(doc_id).alias("matched_doc_id"))
    return rows.withColumn("_k", norm(rows)).join(first, "_k", "left").drop("_k")


def gold_agreement(gold: DataFrame, generated: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """gold rows with found, and for each field whether it agrees; a blank expectation agrees with anything."""
    both = gold.join(generated.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_found")), key, "left")
    agrees = [((F.trim(text_or_blank(f"expected_{f}")) == "") | F.coalesce(F.col(f"expected_{f}") == F.col(f"_{f}"), F.lit(False))).alias(f"{f}_agrees") for f in fields]
    return both.select(key, F.coalesce("_found", F.lit(False)).alias("found"), *agrees)


def compare_runs(runs: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Inner join of several runs on their keys, one value column a run."""
    out = None
    for name, df in runs.items():
        part = df.select(*keys, F.col(value).alias(name))
        out = part if out is None else out.join(part, list(keys))
    return out


def answers_by_id(rows: DataFrame, answers: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """rows with answers; a row without one gets the defaults and missing = true."""
    both = rows.join(answers.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def consolidate_by_priority(rows: DataFrame, keys: Sequence[str], priority: dict[str, int], column: str, position: str, joined: dict[str, str]) -> DataFrame:
    """Groups with the strongest value of a column by priority and ordered distinct joins of others."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in priority.items() for x in p])[F.col(column)], F.lit(len(priority)))
    best = rows.groupBy(*keys).agg(F.min_by(column, F.struct(rank, F.col(position))).alias(column))
    return with_group(best, joined_values(rows, keys, position, joined), keys)


def pool_pairs(pool: DataFrame, requirements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs whose requirement is known, without scores and ranks."""
    hidden = [c for c in pool.columns if c.endswith(("score", "rank"))]
    return pool.drop(*hidden).join(requirements, list(keys))


def scoped_truth(chunks: DataFrame, positives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every chunk's positive rows, or one row with a null document where it has none."""
    return chunks.select(*keys).distinct().join(positives, list(keys), "left").withColumn("has_match", F.col("doc_id").isNotNull())


def label_accuracy(rows: DataFrame, bucket: str) -> DataFrame:
    """Per bucket: human label over model label; accuracy counts yes against yes, no and partial; unlabelled rows stay out."""
    label = F.lower(F.coalesce(F.when(F.trim(text_or_blank("human_label")) != "", F.trim("human_label")), F.when(F.trim(text_or_blank("model_label")) != "", F.trim("model_label"))))
    out = rows.withColumn("_l", label).groupBy(bucket).agg(F.count("_l").alias("labelled"), F.count_if(F.col("_l") == "yes").alias("yes"), F.count_if(F.col("_l") == "partial").alias("partial"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("accuracy", F.when(F.col("labelled") > 0, F.round(F.col("yes") / F.col("labelled"), 6)))


def review_sample(rows: DataFrame, promotable: Column, unique: str, most: int, seed: int) -> DataFrame:
    """Generated rows tagged promotable or control, at most `most` of each by a seeded hash, with blank human columns."""
    tagged = rows.filter(F.col("date_status").isin("generated", "fi_complete")).withColumn("tag", F.when(promotable, "promotable").otherwise("control"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unique).cast("string")))
    tagged = tagged.withColumn("_r", ranked(["tag"], order, F.col(unique))).filter(F.col("_r") <= most).drop("_r")
    return tagged.withColumns({"human_label": F.lit(""), "human_note": F.lit("")})


def inferred_scope(title: ColumnOrName) -> Column:
    """Vendor for vendor documents, else EPC."""
    return F.when(contains_any(F.upper(text_or_blank(title)), ("DATA SHEET", "DATASHEET", "PERFORMANCE CURVE", "SHOP DRAWING", "VENDOR")), "Vendor").otherwise("EPC")

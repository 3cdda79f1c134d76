"""Cleaning of register rows before they are scheduled: an ordered fold over what the title tells.

A row's fields travel as one struct with the actions, sources, conflicts and
confidence so far; each step sees what the last one left. Scopes that the title
names are taken one after the other, so a field that one of them has filled is
there for the next to agree or clash with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import contains_any, ladder, text_or_blank
from dossier.functions.text import collapse
from dossier.functions.vocabulary import SIBLINGS, extract_deliverable, normalize_deliverable, scope_keys
from dossier.operators.registers import normalize_equipment, refine_deliverable

FIELDS = ("equipment", "system", "building", "deliverable")
# Words that name a deliverable and no system; titles that say nothing.
DELIVERABLE_ONLY = ("arrangement", "calculation", "calculations", "data", "datasheet", "detail", "diagram", "drawing", "list", "manual", "plan", "procedure", "report", "schedule", "sheet", "specification", "study", "test")
GARBAGE = ("", "s", "-", "nan", "none", "null")
# The field and the name that a scope stands for.
EQUIPMENT_OF_SCOPE = {
    "acc": "Air Cooled Condenser", "bsedg": "Blackstart Emergency Diesel Generator", "crane_hoist": "Crane & Hoist", "dcs": "DCS", "fgp": "Fuel Gas Package", "gtg": "Gas Turbine Generator",
    "gsut_uat": "GSUT/UAT Transformer", "h2": "Hydrogen System", "hrsg": "Heat Recovery Steam Generator", "mv_lv": "MV/LV Switchgear", "n2": "Nitrogen System", "reserve_boiler": "Reserve Boiler",
    "stg": "Steam Turbine & Generator", "tank": "Tank",
}
SYSTEM_OF_SCOPE = {
    "bop": "Balance of Plant", "ccw": "Closed Cooling Water System", "cems": "Continuous Emissions Monitoring System", "compressed_air": "Compressed Air System", "condensate": "Condensate System",
    "dc_ups": "DC & UPS System", "electrical": "Electrical System", "feedwater": "Feedwater System", "fire_fighting": "Fire Fighting System", "hvac": "HVAC System", "sampling": "Sampling System",
    "service_water": "Service Water System", "steam": "Steam System", "wts": "Water Treatment System",
}
# Buildings by their words, first hit wins; titles of the whole plant.
BUILDINGS = (
    ("Central Control Building", ("CENTRAL CONTROL BUILDING", "CCR")),
    ("Water Treatment Building", ("WATER TREATMENT BUILDING",)),
    ("Local Electrical Building", ("LOCAL ELECTRICAL BUILDING", "LOCAL ELECTRICAL ROOM", "LEB")),
    ("Steam Turbine Building", ("STEAM TURBINE BUILDING", "ST BUILDING")),
    ("Administration & Social Building", ("ADMINISTRATION & SOCIAL BUILDING", "ADMINISTRATION BUILDING")),
    ("Fire Water Pump House", ("FIRE WATER PUMP HOUSE", "FIRE PUMP HOUSE")),
    ("Pipe Rack", ("PIPE RACK", "PIPERACK")),
    ("Workshop & Storage Building", ("WORKSHOP & STORAGE BUILDING", "WORKSHOP", "STORAGE BUILDING")),
    ("Air Compressor Shelter", ("AIR COMPRESSOR SHELTER",)),
    ("Chemical Dosing Shelter", ("CHEMICAL DOSING SHELTER",)),
    ("Security Building", ("SECURITY BUILDING", "MAIN GATE HOUSE", "SEARCH FACILITY", "VISITORS CENTRE")),
    ("Support Building", ("SUPPORT BUILDING",)),
)
PLANT_GENERAL = (
    "DOCUMENT IDENTIFICATION", "EQUIPMENT AND SYSTEM IDENTIFICATION", "SITE PLAN", "PLOT PLAN", "HEAT BALANCE", "WATER BALANCE", "ABBREVIATION LIST", "NAME AND TAG PLATE", "DANGER SIGN",
    "UNDERGROUND PIPE MARKER", "MAINTAINABILITY STUDY", "CORROSION AND MATERIAL STUDY", "BUILDING RISK ASSESSMENT",
)


def _plain(phrase: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in phrase.upper().replace("&", " AND")).split())


def cell(x) -> Column:
    """Text with single blanks; words for nothing are blank."""
    text = collapse(F.translate(text_or_blank(x), " ", " "))
    return F.when(F.lower(text).isin("nan", "none", "null"), "").otherwise(text)


def chosen_variant(x: Column) -> Column:
    """Of variants parted by `|`, the name of most words, then of most characters, then the first."""
    variants = F.filter(F.transform(F.split(x, "\\|"), lambda v: F.trim(v)), lambda v: v != "")
    sized = F.transform(variants, lambda v, i: F.struct(F.size(F.split(normalize_equipment(v), " ")).alias("words"), F.length(normalize_equipment(v)).alias("size"), (-i).alias("first"), normalize_equipment(v).alias("name")))
    return F.when(x.contains(" | "), F.coalesce(F.array_max(sized)["name"], F.lit(""))).otherwise(x)


def building_in(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.replace(F.upper(text), F.lit("&"), F.lit(" AND")), "[^A-Z0-9]+", " "))
    return ladder(*[(contains_any(plain, [_plain(w) for w in words]), name) for name, words in BUILDINGS])


def canonical_deliverable(value: Column, title: Column) -> Column:
    refined = refine_deliverable(value, title)
    return normalize_deliverable(F.when(refined != "", refined).otherwise(extract_deliverable(title)))


def _with(state: Column, **changes: Column) -> Column:
    for name, value in changes.items():
        state = state.withField(name, value)
    return state


def _told(state: Column, action: Column | None = None, source: Column | None = None, conflict: Column | None = None, confidence: float = 1.0) -> Column:
    """The state with what a step did appended."""
    for name, value in (("actions", action), ("sources", source), ("conflicts", conflict)):
        if value is not None:
            state = state.withField(name, F.array_append(state[name], value))
    return state.withField("confidence", F.least(state["confidence"], F.lit(confidence)))


def _moved_deliverable(s: Column) -> Column:
    """A system that is a deliverable's name goes to the deliverable, or just goes."""
    empty = _with(s, system=F.lit(""))
    moved = _told(_with(empty, deliverable=normalize_deliverable(s["system"])), F.lit("moved_system_value_to_deliverable"), confidence=0.9)
    cleared = _told(empty, F.lit("cleared_deliverable_value_from_system"), confidence=0.9)
    return F.when(F.lower(s["system"]).isin(*DELIVERABLE_ONLY), F.when(s["deliverable"] == "", moved).otherwise(cleared)).otherwise(s)


def _filled_building(s: Column, found: Column) -> Column:
    filled = _told(_with(s, building=found), F.lit("filled_building_from_title_or_others"), F.lit("building:title_or_others"), confidence=0.85)
    same = F.upper(F.regexp_replace(s["building"], "[^A-Za-z0-9]+", " ")) == F.upper(F.regexp_replace(found, "[^A-Za-z0-9]+", " "))
    clash = _told(s, conflict=F.concat(F.lit("building_conflict:"), s["building"], F.lit("!=detected:"), found))
    return F.when(found == "", s).when(s["building"] == "", filled).when(~same, clash).otherwise(s)


def _foreign(scope: Column, keys: Column) -> Column:
    """Whether known scope keys leave no room for this one."""
    room = F.array_contains(keys, scope)
    for group in SIBLINGS:
        room = room | (scope.isin(*group) & F.arrays_overlap(keys, F.array(*[F.lit(g) for g in group])))
    return (F.size(keys) > 0) & ~room


def _filled_scope(s: Column, scope: Column) -> Column:
    """One detected scope: it fills its field, agrees, or clashes with what is known by now."""
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    of_equipment, of_system = table(EQUIPMENT_OF_SCOPE)[scope], table(SYSTEM_OF_SCOPE)[scope]
    by_equipment, name = of_equipment.isNotNull(), F.coalesce(of_equipment, of_system)
    field = F.when(by_equipment, "equipment").otherwise("system")
    current = F.when(by_equipment, s["equipment"]).otherwise(s["system"])
    known, own = scope_keys(F.concat_ws(" ", s["equipment"], s["system"], s["building"])), scope_keys(current)
    clash = _told(s, conflict=F.concat(F.lit("structured_scope_conflict:existing="), F.array_join(known, ","), F.lit(";detected="), scope))
    put = _with(s, equipment=F.when(by_equipment, name).otherwise(s["equipment"]), system=F.when(by_equipment, s["system"]).otherwise(name))
    filled = _told(put, F.concat(F.lit("filled_"), field, F.lit("_from_scope:"), scope), F.concat(field, F.lit(":title_or_others")), confidence=0.8)
    odd = _told(s, conflict=F.concat(field, F.lit("_scope_conflict:"), current, F.lit("!=detected:"), name))
    return F.when(name.isNull(), s).when(_foreign(scope, known), clash).when(current == "", filled).when(_foreign(scope, own), odd).otherwise(s)


def _filled_deliverable(s: Column, found: Column) -> Column:
    filled = _told(_with(s, deliverable=found), F.lit("filled_deliverable_from_title"), F.lit("deliverable:title"), confidence=0.85)
    return F.when((found != "") & (s["deliverable"] == ""), filled).otherwise(s)


def _plant_general(s: Column, title: Column) -> Column:
    bare = (s["equipment"] == "") & (s["system"] == "") & (s["building"] == "")
    general = _told(_with(s, system=F.lit("Plant General System")), F.lit("assigned_plant_general_scope"), F.lit("system:plant_general_title"), confidence=0.75)
    return F.when(bare & contains_any(F.upper(title), PLANT_GENERAL), general).otherwise(s)


def cleaned_register(rows: DataFrame) -> DataFrame:
    """rows (title, others and FIELDS) cleaned, with each field's original and what was done.

    Adds the FIELDS' `_original`, cleaning_actions, cleaning_confidence (two
    digits), scope_status, scope_fill_source, scope_conflict_reason and
    needs_human_review. A conflict overrides every other status; no field that
    held a value loses it to a detected one.
    """
    kept = [c for c in rows.columns if c not in FIELDS]
    df = rows.withColumns({"_title": cell("title"), "_others": cell("others")} | {f"{c}_original": cell(c) for c in FIELDS})
    own = lambda c: chosen_variant(F.col(f"{c}_original"))
    building = building_in(own("building"))
    df = df.withColumns({
        "_equipment": normalize_equipment(own("equipment")), "_system": own("system"), "_building": F.when(building != "", building).otherwise(own("building")),
        "_deliverable": canonical_deliverable(own("deliverable"), F.col("_title")), "_scopes": scope_keys(F.concat_ws(" ", "_title", "_others")), "_found": building_in(F.concat_ws(" ", "_title", "_others")),
    })
    changed = F.lit(False)
    for c in FIELDS:
        changed = changed | (F.col(f"_{c}") != F.col(f"{c}_original"))
    none = F.array().cast("array<string>")
    first = F.struct(
        *[F.col(f"_{c}").alias(c) for c in FIELDS], F.when(changed, F.array(F.lit("canonicalized_existing_fields"))).otherwise(none).alias("actions"), none.alias("sources"), none.alias("conflicts"),
        F.when(changed, 0.95).otherwise(1.0).alias("confidence"),
    )
    steps = (
        lambda s: _moved_deliverable(s), lambda s: _filled_building(s, F.col("_found")), lambda s: F.aggregate(F.col("_scopes"), s, _filled_scope),
        lambda s: _filled_deliverable(s, canonical_deliverable(F.lit(""), F.col("_title"))), lambda s: _plant_general(s, F.col("_title")),
    )
    df = df.withColumn("_s", first)
    for step in steps:
        df = df.withColumn("_s", step(F.col("_s")))
    general = F.array_contains("_s.actions", "assigned_plant_general_scope")
    garbage = F.lower("_title").isin(*GARBAGE) | (F.length("_title") <= 1)
    actions = F.when(garbage, F.array_append("_s.actions", F.lit("flagged_garbage_title"))).otherwise(F.col("_s.actions"))
    clash = F.size("_s.conflicts") > 0
    status = ladder((clash, "conflict"), (garbage, "invalid_title"), (general, "plant_general"), (F.size("_actions") > 0, "auto_cleaned"), otherwise="ok")
    confidence = F.least(F.col("_s.confidence"), F.when(garbage, 0.2).otherwise(1.0), F.when(clash, 0.35).otherwise(1.0))
    df = df.withColumn("_actions", actions)
    return df.select(
        *kept, *[F.col(f"_s.{c}").alias(c) for c in FIELDS], *[f"{c}_original" for c in FIELDS], F.array_join("_actions", ";").alias("cleaning_actions"), F.format_string("%.2f", confidence).alias("cleaning_confidence"),
        status.alias("scope_status"), F.array_join(F.array_distinct("_s.sources"), ";").alias("scope_fill_source"), F.array_join("_s.conflicts", ";").alias("scope_conflict_reason"),
        F.when(clash | garbage, "true").otherwise("false").alias("needs_human_review"),
    )


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """(name, n): rows, each status, each kind of action, rows in conflict and rows to review."""
    kinds = F.transform(F.filter(F.split("cleaning_actions", ";"), lambda a: a != ""), lambda a: F.concat(F.lit("action:"), F.substring_index(a, ":", 1)))
    marks = F.array_compact(F.array(F.lit("rows"), F.concat(F.lit("scope_status:"), "scope_status"), F.when(F.col("needs_human_review") == "true", "needs_human_review"), F.when(F.col("scope_conflict_reason") != "", "rows_with_conflict")))
    return cleaned.select(F.explode(F.concat(marks, kinds)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))

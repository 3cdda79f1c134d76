"""Vocabularies as data, and the few operators that evaluate them.

`first_match` walks an ordered pattern table, `all_matches` collects every key
of an alias table. The tables hold fixed values of the domain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, text_or_blank
from dossier.functions.text import key_text, slug

Aliases = Sequence[tuple[str, Sequence[str]]]

# Activity scopes and the aliases that name them.
SCOPES: Aliases = (
    ("acc", ("ACC", "AIR COOLED CONDENSER", "COND AIR EXT")),
    ("bop", ("BOP", "BALANCE OF PLANT")),
    ("bsedg", ("BSEDG", "BSDG", "BLACKSTART EMERGENCY DIESEL", "BLACKSTART DIESEL GENERATOR", "BLACKSTART GENERATOR")),
    ("ccw", ("CCW", "CCWP", "CCWS", "CCW H/EX", "CLOSED COOLING WATER", "CLOSED COOLING WATER SYSTEM", "CLOSED COOLING WATER PUMP", "FIN FAN COOLER", "FIN FAN")),
    ("cems", ("CEMS", "CONTINUOUS EMISSIONS MONITORING")),
    ("compressed_air", ("COMPRESSED AIR", "INSTRUMENT AIR", "SERVICE AIR", "AIR COMPRESSOR", "PLANT AIR", "PURGE AIR", "COMP AIR")),
    ("condensate", ("CONDENSATE", "CONDENSATE EXTRACTION", "CONDENSATE SYSTEM", "CEP")),
    ("crane_hoist", ("CRANE & HOIST", "CRANE AND HOIST", "GANTRY CRANE", "CRANE", "HOIST", "JIB CRANE")),
    ("dc_ups", ("DC & UPS", "UPS", "DC SYSTEM", "125V DC", "220V DC", "DIRECT CURRENT", "UNINTERRUPTIBLE POWER SUPPLY")),
    ("dcs", ("DCS", "DISTRIBUTED CONTROL")),
    ("electrical", ("ELECTRICAL", "POWER METERING", "TARIFF METERING", "METERING SYSTEM", "EARTHING", "EARTHING & LIGHTNING", "LIGHTNING PROTECTION", "GROUNDING", "ISOLATED PHASE BUSDUCT", "IPB", "LIGHTING & SMALL POWER", "SMALL POWER")),
    ("feedwater", ("FEEDWATER", "FEED WATER", "BOILER FEED", "FWP", "FWS", "FW PIPING", "BFP")),
    ("fgp", ("FGP", "FUEL GAS", "GAS COMP", "GAS CONDITIONING")),
    ("fire_fighting", ("FIRE FIGHTING", "FIRE PROTECTION", "FIRE WATER", "FIRE SERVICE", "FIRE ALARM", "FIRE DETECTION", "FIRE SUPPRESSION", "FIRE HYDRANT", "SPRINKLER", "STANDPIPE", "STAND PIPE", "CLEAN AGENT", "WATER SPRAY", "DELUGE", "HYDRANT", "FOAM STATION", "FOAM SYSTEM")),
    ("gtg", ("GTG", "GT", "GAS TURBINE", "GAS TURBINE GENERATOR")),
    ("gsut_uat", ("GSUT", "UAT", "UNIT AUXILIARY TRANSFORMER", "STEP UP", "TRANSFORMER")),
    ("h2", ("H2", "HYDROGEN")),
    ("hrsg", ("HRSG", "HEAT RECOVERY STEAM GENERATOR")),
    ("hvac", ("HVAC", "HEATING", "VENTILATING", "AIR CONDITIONING")),
    ("lab", ("LAB", "LABORATORY")),
    ("mv_lv", ("MV SWGR", "LV SWGR", "SWITCHGEAR", "MCC", "MOTOR CONTROL CENTER")),
    ("n2", ("N2", "NITROGEN")),
    ("reserve_boiler", ("RESERVE BOILER", "AUX BOILER", "AUXILIARY BOILER")),
    ("sampling", ("SAMPLING SYSTEM", "SAMPLING EQUIP", "SAMPLING")),
    ("service_water", ("SERVICE WATER", "RAW WATER", "SWS")),
    ("steam", ("MAIN STEAM", "PROCESS STEAM", "HP STEAM", "IP STEAM", "LP STEAM", "AUXILIARY STEAM", "AUX STEAM", "STEAM DRAIN", "STEAM PIPING", "STEAM SYSTEM")),
    ("stg", ("STG", "ST", "STEAM TURBINE", "STEAM TURBINE GENERATOR", "STEAM TURBINE & GENERATOR")),
    ("wts", ("WTS", "WWTS", "WATER TREATMENT", "WASTE WATER", "EFFLUENT", "STP", "SEWAGE", "CHEMICAL DOSING", "CHEMICAL DOSING SYSTEM", "DM WATER", "DEMINERALIZED WATER", "POTABLE WATER")),
)
# Scopes that cut across systems; scopes that stand for one system.
DISCIPLINES = ("electrical", "hvac")
SIBLINGS = (("acc", "condensate"),)
# Deliverable families, most specific pattern first.
FAMILIES = (
    ("classification", "hazardous_area_classification", ("HAZARDOUS AREA CLASSIFICATION", "AREA CLASSIFICATION")),
    ("curve", "generator_capability_curve", ("GENERATOR CAPABILITY CURVES AND DATA", "CAPABILITY CURVES AND DATA", "CAPABILITY CURVES")),
    ("curve", "performance_curve", ("PERFORMANCE DATA AND CURVES", "PERFORMANCE CURVES", "PERFORMANCE CURVE", "PERFORMANCE DATA")),
    ("list", "io_list", ("I/O LIST", "IO LIST", "INPUT OUTPUT LIST", "INPUT / OUTPUT LIST")),
    ("list", "instrument_list", ("INSTRUMENT LIST", "LIST AND DATA SHEET FOR INSTRUMENT")),
    ("list", "equipment_list", ("EQUIPMENT LIST",)),
    ("list", "valve_list", ("VALVE LIST",)),
    ("list", "cable_schedule", ("CABLE SCHEDULE",)),
    ("schedule", "schedule", ("SCHEDULE",)),
    ("report", "cfd_report", ("CFD REPORT",)),
    ("report", "pre_fat_report", ("PRE FAT REPORT", "PRE-FAT REPORT")),
    ("report", "design_report", ("DESIGN REPORT",)),
    ("report", "study_report", ("STUDY REPORT",)),
    ("report", "test_report", ("TEST REPORT",)),
    ("report", "report", ("REPORT",)),
    ("specification", "painting_specification", ("PAINTING SPECIFICATION", "PAINT SPECIFICATION")),
    ("specification", "insulation_specification", ("INSULATION SPECIFICATION",)),
    ("specification", "fan_specification", ("FAN SPECIFICATION",)),
    ("specification", "drain_pump_specification", ("DRAIN PUMP SPECIFICATION", "CONDENSATE DRAIN PUMP SPECIFICATION")),
    ("specification", "scr_specification", ("SPECIFICATION FOR SCR", "TECHNICAL SPECIFICATION FOR SCR")),
    ("specification", "cable_specification", ("CABLE SPECIFICATION",)),
    ("specification", "gas_detector_specification", ("GAS DETECTOR SPECIFICATION",)),
    ("specification", "pump_specification", ("PUMP SPECIFICATION",)),
    ("specification", "technical_specification", ("TECHNICAL SPECIFICATIONS", "TECHNICAL SPECIFICATION")),
    ("specification", "specification", ("SPECIFICATION",)),
    ("datasheet", "technical_data_sheet", ("TECHNICAL DATA SHEET", "TECHNICAL DATASHEET")),
    ("datasheet", "data_sheet", ("DATA SHEET", "DATASHEET")),
    ("manual", "operation_maintenance_manual", ("OPERATION & MAINTENANCE MANUAL", "O&M MANUAL")),
    ("manual", "assembly_manual", ("ASSEMBLY MANUAL",)),
    ("manual", "manual", ("MANUAL",)),
    ("description", "system_description", ("SYSTEM DESCRIPTION",)),
    ("description", "control_description", ("CONTROL DESCRIPTION", "CONTROL PHILOSOPHY")),
    ("diagram", "p_id", ("P&I DIAGRAM", "P&ID", "PIPING AND INSTRUMENTATION DIAGRAM")),
    ("diagram", "single_line_diagram", ("SINGLE LINE DIAGRAM", "SLD")),
    ("diagram", "power_distribution_diagram", ("POWER DISTRIBUTION CONCEPT DIAGRAM", "POWER DISTRIBUTION DIAGRAM")),
    ("diagram", "hmi_graphic_diagram", ("HMI GRAPHIC DIAGRAM",)),
    ("diagram", "control_logic_diagram", ("ELECTRICAL CONTROL LOGIC DIAGRAM", "CONTROL LOGIC DIAGRAM")),
    ("diagram", "functional_loop_diagram", ("FUNCTIONAL LOOP DIAGRAM",)),
    ("diagram", "control_loop_diagram", ("CONTROL LOOP DIAGRAM", "CONTROL LOOP")),
    ("diagram", "wiring_diagram", ("WIRING DIAGRAM",)),
    ("diagram", "schematic_diagram", ("SCHEMATIC DIAGRAM", "SCHEMATICS", "SCHEMATIC")),
    ("diagram", "diagram", ("DIAGRAM",)),
    ("drawing", "general_arrangement_drawing", ("GENERAL ARRANGEMENT DRAWING", "GENERAL ARRANGEMENT", "GA DRAWING")),
    ("drawing", "layout_drawing", ("LAYOUT DRAWING", "LAYOUT")),
    ("drawing", "outline_drawing", ("OUTLINE DRAWING",)),
    ("drawing", "isometric_drawing", ("ISOMETRIC DRAWING", "ISOMETRIC")),
    ("drawing", "detail_drawing", ("DETAIL DRAWING", "DETAIL")),
    ("drawing", "sectional_drawing", ("SECTIONAL DRAWING", "SECTION")),
    ("drawing", "drawing", ("DRAWING",)),
    ("calculation", "sizing_calculation", ("SIZING CALCULATION",)),
    ("calculation", "design_calculation", ("DESIGN CALCULATION",)),
    ("calculation", "calculation", ("CALCULATION SHEET", "CALCULATION")),
    ("procedure", "test_procedure", ("TEST PROCEDURE",)),
    ("procedure", "procedure", ("PROCEDURE",)),
    ("criteria", "design_criteria", ("DESIGN CRITERIA", "CRITERIA")),
    ("requirements", "design_requirements", ("DESIGN REQUIREMENTS", "REQUIREMENTS")),
    ("plan", "plan", ("PLAN",)),
    ("notes", "general_notes", ("GENERAL NOTES", "NOTES")),
    ("model", "model", ("MODEL",)),
    ("data", "operational_data", ("OPERATIONAL DATA",)),
    ("data", "data", ("DATA",)),
)
# Deliverable words, most specific first, and the wording that rules use for them.
DELIVERABLE_WORDS = (
    "P&I DIAGRAM", "P&ID", "PIPING AND INSTRUMENTATION DIAGRAM", "PIPING & INSTRUMENTATION DRAWING", "GENERAL ARRANGEMENT DRAWING",
    "GENERAL ARRANGEMENT", "GA DRAWING", "PIPING ARRANGEMENT DRAWING", "ARRANGEMENT DRAWING", "ARRANGEMENT", "LAYOUT DRAWING", "LAYOUT",
    "ELECTRICAL CONTROL LOGIC DIAGRAM", "FUNCTIONAL LOOP DIAGRAM", "CONTROL LOOP DIAGRAM", "CONTROL LOGIC DIAGRAM", "SINGLE LINE DIAGRAM",
    "SCHEMATIC DIAGRAM", "WIRING DIAGRAM", "LOGIC DIAGRAM", "SIZING CALCULATION", "CALCULATION SHEET", "DESIGN CALCULATION", "CALCULATION",
    "TECHNICAL DATA SHEET", "TECHNICAL DATASHEET", "DATA SHEET", "DATASHEET", "OUTLINE DRAWING", "ISOMETRIC DRAWING", "DETAIL DRAWING",
    "SECTIONAL DRAWING", "PIPING ISO DRAWING", "ELEVATION", "PLAN & SECTION", "PLAN AND SECTION", "DRAWING", "PAINTING SPECIFICATION",
    "PAINT SPECIFICATION", "TECHNICAL SPECIFICATIONS", "TECHNICAL SPECIFICATION", "SPECIFICATION", "DESIGN CRITERIA", "CRITERIA",
    "DESIGN REQUIREMENTS", "REQUIREMENTS", "OPERATION & MAINTENANCE MANUAL", "ASSEMBLY MANUAL", "MANUAL", "SYSTEM DESCRIPTION", "CONTROL DESCRIPTION",
    "CONTROL PHILOSOPHY", "OVERVIEW", "SUMMARY", "INSTRUMENT LIST", "VALVE LIST", "CABLE SCHEDULE", "SCHEDULE", "LIST", "DATABASE", "TEST PROCEDURE",
    "TEST REPORT", "TEST", "PROCEDURE", "STUDY REPORT", "DESIGN REPORT", "HAZARDOUS AREA CLASSIFICATION", "REPORT", "STUDY", "MODEL",
    "GENERATOR CAPABILITY CURVES AND DATA", "CAPABILITY CURVES AND DATA", "CAPABILITY CURVES", "PERFORMANCE DATA AND CURVES", "PERFORMANCE CURVES",
    "PERFORMANCE CURVE", "PERFORMANCE DATA", "CURVES", "CURVE", "SCHEMATICS", "SCHEMATIC", "GENERAL NOTES", "NOTES", "PLAN",
    "FOUNDATION AND LOADING DATA", "OPERATIONAL DATA", "SETTINGS", "ISOMETRIC", "ASSEMBLY", "OUTLINE", "SECTION", "DETAIL", "DIAGRAM", "DATA",
)
RULE_WORDS = {
    "P&I DIAGRAM": "P&ID", "P&I DRAWING": "P&ID", "P&ID": "P&ID", "PIPING & INSTRUMENTATION DRAWING": "P&ID",
    "PIPING AND INSTRUMENTATION DRAWING": "P&ID", "PIPING AND INSTRUMENTATION DIAGRAM": "P&ID", "GENERAL ARRANGEMENT": "General Arrangement Drawing",
    "GA": "General Arrangement Drawing", "GA DRAWING": "General Arrangement Drawing", "ARRANGEMENT DRAWING": "General Arrangement Drawing",
    "LAYOUT": "Layout Drawing", "LAYOUT DRAWING": "Layout Drawing", "CALCULATION": "Calculation sheet", "SIZING CALCULATION": "Calculation sheet",
    "PAINTING SPECIFICATION": "Painting Specification", "PAINT SPECIFICATION": "Painting Specification",
    "TECHNICAL SPECIFICATION": "Technical Specification", "SPECIFICATION": "Technical Specification", "DATA SHEET": "Data Sheet",
    "DATASHEET": "Data Sheet", "GENERATOR CAPABILITY CURVES AND DATA": "Generator Capability Curves and Data",
    "CAPABILITY CURVES AND DATA": "Generator Capability Curves and Data", "CAPABILITY CURVES": "Generator Capability Curves and Data",
    "PERFORMANCE DATA AND CURVES": "Performance Data and Curves", "PERFORMANCE CURVES": "Performance Curve", "PERFORMANCE CURVE": "Performance Curve",
    "PERFORMANCE DATA": "Performance Data and Curves", "CURVES": "Performance Curve", "CURVE": "Performance Curve",
    "OUTLINE DRAWING": "Outline Drawing", "SINGLE LINE DIAGRAM": "Single Line Diagram", "SLD": "Single Line Diagram", "DETAIL": "Detail Drawing",
    "DETAIL DRAWING": "Detail Drawing", "ELEVATION": "Elevation Drawing", "DIAGRAM": "Diagram", "ISOMETRIC": "Isometric Drawing",
    "ISOMETRIC DRAWING": "Isometric Drawing", "FOUNDATION AND LOADING DATA": "Foundation and Loading Data",
    "SYSTEM DESCRIPTION": "System Description", "PLAN": "Plan", "SCHEDULE": "Schedule",
}
# Phase words of documents and of activities, in order of precedence.
QUERY_PHASES = (
    ("design_criteria", ("DESIGN CRITERIA",)),
    ("system_design", ("P&ID", "P&I", "SYSTEM DESCRIPTION", "CONFIGURATION", "LOGIC", "CLASSIFICATION")),
    ("procurement", ("SPECIFICATION", "DATA SHEET", "DATASHEET", "CURVE")),
    ("civil_design", ("FOUNDATION", "DESIGN REPORT", "CALCULATION")),
)
STUDY_WORDS = ("STUDY", "REPORT", "CLASSIFICATION")
DRAWING_WORDS = ("LAYOUT", "ARRANGEMENT", "OUTLINE", "DRAWING", "DIAGRAM")
CIVIL_WORDS = ("FOUNDATION", "FDN", "STRUCTURE", "BUILDING", "SHELTER", "PIPE RACK", "PLOT PLAN", "SITE PLAN", "ARCHITECTURAL", "CIVIL")
CIVIL_DRAWING_WORDS = (*CIVIL_WORDS, "ELEVATION", "SECTION", "REBAR", "EMBEDDED")
STUDY_SYSTEM_WORDS = ("HAZOP", "SIL", "OPERABILITY", "HARMONIC", "SHORT CIRCUIT", "LOAD FLOW", "PROTECTION RELAY", "PHILOSOPHY", "ANALYSIS", "CFD", "PERFORMANCE", "PROCESS", "SYSTEM")
SYSTEM_DRAWING_WORDS = ("P&ID", "P&I", "FLOW DIAGRAM", "CONTROL LOOP", "CONTROL LOGIC", "WIRING", "ELEMENTARY", "SINGLE LINE", "ISOMETRIC", "I/O", "OUTLINE DRAWING", "ARRANGEMENT DRAWING FOR")
LATE_PHASES = (
    ("commissioning", ("COMMISSIONING", "TEST")),
    ("manual", ("MANUAL", "O&M", "OPERATION & MAINTENANCE", "OPERATION AND MAINTENANCE")),
    ("procurement", ("TERMINAL POINT LIST", "LOAD LIST", "I/O LIST", "SIGNAL LIST", "CABLE LIST")),
    ("design_drawing", DRAWING_WORDS),
)
ACTIVITY_PHASES = (
    ("design_criteria", ("DESIGN CRITERIA",)),
    ("system_design", ("P&ID", "P&I", "SYSTEM DESIGN", "PROCESS", "CONFIGURATION", "LOGIC")),
    ("delivery", ("TRANSPORTATION", "DELIVERY", "FOB")),
    ("commissioning", ("COMMISSIONING", "TEST")),
    ("civil_design", ("FDN", "FOUNDATION", "CIVIL", "STRUCTURE DESIGN", "SHELTER DESIGN")),
    ("procurement", ("P.O", "PROCUREMENT", "KEY DATA", "MPS", "VENDOR")),
    ("installation", ("INSTALLATION", "ERECTION")),
)
KEYWORD_PHASES = (("delivery", ("delivery", "fob", "transportation", "fo b")), ("procurement", ("p.o", "po", "pof", "manufacturing")), ("commissioning", ("commissioning",)))
COMPATIBLE_PHASES = (
    ("design_drawing", "system_design"), ("design_drawing", "civil_design"), ("manual", "delivery"), ("manual", "procurement"),
    ("manual", "installation"), ("design_criteria", "system_design"), ("design_criteria", "civil_design"),
)
# Activity phases open to a document's phase, and the terms that steer its activity query.
PHASE_BUCKETS = {
    "design_criteria": ("design_criteria", "system_design", "civil_design"), "design_drawing": ("system_design", "civil_design"),
    "system_design": ("system_design",), "civil_design": ("civil_design",), "procurement": ("procurement",), "commissioning": ("commissioning",),
    "manual": ("delivery", "procurement", "installation"), "delivery": ("delivery", "procurement"),
}
DELIVERABLE_BOOST = {
    "DESIGN CRITERIA": "Design Criteria engineering", "SYSTEM DESCRIPTION": "System Description P&ID", "LAYOUT": "Layout Arrangement Drawing",
    "OVERVIEW": "System Description overview",
}
KEYWORD_BOOST = {
    "p.o": "P.O Procurement", "po": "P.O Procurement", "pof": "P.O Procurement finish", "delivery": "transportation delivery",
    "fob": "transportation delivery FOB", "transportation": "transportation delivery", "manufacturing": "manufacturing P.O",
    "fo b": "transportation delivery", "commissioning": "commissioning test",
}
# Score multipliers by status, and tokens that confirm nothing.
PHASE_FACTOR = {"match": 1.0, "compatible": 0.75, "query_unknown": 0.75, "activity_unknown": 0.75, "mismatch": 0.25}
SCOPE_FACTOR = {"match": 1.0, "query_unscoped": 0.75, "activity_unscoped": 0.75, "discipline_only": 0.5, "mismatch": 0.25}
GENERIC_FACTOR = 0.8
RULE_SCOPE_FACTOR = 0.5
GENERIC_TOKENS = (
    "system", "design", "drawing", "data", "calculation", "list", "report", "manual", "specification", "diagram", "plan", "layout", "arrangement", "detail",
    "sheet", "general", "equipment", "technical", "load", "civil", "structure", "outline", "section", "schedule", "study", "vendor", "package", "area", "building",
)


def alias_pattern(aliases: Sequence[str]) -> str:
    """Whole-word match of any alias; a word ends at characters outside A-Z and 0-9."""
    return "(?<![A-Z0-9])(?:" + "|".join(f"\\Q{a}\\E" for a in aliases) + ")(?![A-Z0-9])"


def all_matches(text: ColumnOrName, table: Aliases) -> Column:
    """Sorted keys of every entry with an alias in the text."""
    value = F.upper(text_or_blank(text))
    return F.array_sort(F.array_compact(F.array(*[F.when(value.rlike(alias_pattern(aliases)), F.lit(key)) for key, aliases in table])))


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], otherwise: ColumnOrName = "") -> Column:
    return ladder(*[(contains_any(text, terms), key) for key, terms in table], otherwise=otherwise)


def scope_keys(text: ColumnOrName) -> Column:
    return all_matches(text, SCOPES)


def extract_deliverable(text: ColumnOrName) -> Column:
    upper = F.upper(text_or_blank(text))
    return ladder(*[(upper.contains(w), w) for w in DELIVERABLE_WORDS])


def normalize_deliverable(value: ColumnOrName) -> Column:
    key = F.upper(F.trim(text_or_blank(value)))
    return F.coalesce(F.create_map(*[F.lit(x) for p in RULE_WORDS.items() for x in p])[key], F.trim(text_or_blank(value)))


def deliverable_type(deliverable: ColumnOrName, title: ColumnOrName) -> Column:
    """Struct (family, subtype): the first pattern in deliverable (as it is and as rules word it) and title; else `other` and a slug; blank stays blank."""
    parts = (text_or_blank(deliverable), normalize_deliverable(deliverable), extract_deliverable(title), text_or_blank(title))
    padded = [(family, subtype, [_plain(p) for p in patterns]) for family, subtype, patterns in FAMILIES]
    fallback = slug(F.coalesce(*[F.when(F.trim(p) != "", p) for p in parts[1:]], F.lit("")))

    def kind(text: Column) -> Column:
        out = F.when(text == "", F.struct(F.lit("").alias("family"), F.lit("").alias("subtype")))
        for family, subtype, patterns in padded:
            out = out.when(contains_any(text, patterns), F.struct(F.lit(family).alias("family"), F.lit(subtype).alias("subtype")))
        return out.otherwise(F.struct(F.lit("other").alias("family"), fallback.alias("subtype")))

    return bound(key_text(F.concat_ws(" ", *parts)), kind)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain(pattern: str) -> str:
    import re

    return re.sub(r"[^A-Z0-9]+", " ", pattern.upper().replace("&", " AND")).strip()


def keyword_phase(keywords: Column) -> Column:
    words = F.transform(keywords, lambda k: F.lower(F.trim(k)))
    return ladder(*[(F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms])), key) for key, terms in KEYWORD_PHASES])


def query_phase(deliverable: ColumnOrName, title: ColumnOrName, scope: ColumnOrName, keywords: Column | None = None) -> Column:
    """Phase of a document from its wording, then from the rule's activity keywords."""
    text = F.upper(F.concat_ws(" ", text_or_blank(deliverable), text_or_blank(title)))
    where = F.upper(text_or_blank(scope))
    either = lambda words: contains_any(text, words) | contains_any(where, words)
    study, drawing = contains_any(text, STUDY_WORDS), contains_any(text, DRAWING_WORDS)
    steps = [(contains_any(text, terms), key) for key, terms in QUERY_PHASES]
    steps += [(study & either(CIVIL_WORDS), "civil_design"), (study & either(STUDY_SYSTEM_WORDS), "system_design"), (contains_any(text, ("SITE PLAN", "PLOT PLAN")), "civil_design")]
    steps += [(drawing & either(CIVIL_DRAWING_WORDS), "civil_design"), (drawing & either(SYSTEM_DRAWING_WORDS), "system_design")]
    steps += [(drawing & text.contains("GENERAL ARRANGEMENT") & (F.trim(where) != ""), "system_design")]
    steps += [(contains_any(text, terms), key) for key, terms in LATE_PHASES]
    return ladder(*steps, otherwise="" if keywords is None else keyword_phase(keywords))


def activity_query(equipment: ColumnOrName, system: ColumnOrName, deliverable: ColumnOrName, title: ColumnOrName, keywords: Column | None = None) -> Column:
    """The document's words, then the terms of its deliverable, or else those of each of the rule's activity keywords."""
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    parts = [F.trim(x) for x in (text_or_blank(equipment), text_or_blank(system), normalize_deliverable(deliverable), text_or_blank(title))]
    boost = table(DELIVERABLE_BOOST)[F.upper(F.trim(text_or_blank(deliverable)))]
    if keywords is not None:
        terms = F.array_compact(F.transform(keywords, lambda k: table(KEYWORD_BOOST)[F.lower(F.trim(k))]))
        boost = F.coalesce(boost, F.when(F.size(terms) > 0, F.array_join(terms, " ")))
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts], boost)


def activity_phase(text: ColumnOrName) -> Column:
    return first_match(F.upper(text_or_blank(text)), ACTIVITY_PHASES)


def phase_status(query: ColumnOrName, activity: ColumnOrName, rule: ColumnOrName | None = None) -> Column:
    q, a = col(query), col(activity)
    by_rule = F.lit(False) if rule is None else col(rule) == a
    pairs = F.lit(False)
    for x, y in COMPATIBLE_PHASES:
        pairs = pairs | ((q == x) & (a == y))
    return ladder((q == "", "query_unknown"), (a == "", "activity_unknown"), ((q == a) | by_rule, "match"), (pairs, "compatible"), otherwise="mismatch")


def scope_status(query: Column, activity: Column) -> Column:
    """How two scope sets agree; overlap on a discipline alone is weak where the query names a system."""
    systems = F.array_except(query, F.array(*[F.lit(d) for d in DISCIPLINES]))
    return ladder(
        (F.size(query) == 0, "query_unscoped"), (F.size(activity) == 0, "activity_unscoped"), (~F.arrays_overlap(query, activity), "mismatch"),
        ((F.size(systems) == 0) | F.arrays_overlap(systems, activity), "match"), otherwise="discipline_only",
    )


def document_scope(structured: Column, title: Column, others: Column) -> Column:
    """Struct (keys, origin, conflict): structured fields first, both where the title disagrees, then title, then others."""
    has = lambda x: F.size(x) > 0
    clash = has(structured) & has(title) & ~F.arrays_overlap(structured, title)
    keys = F.when(clash, F.array_sort(F.array_union(structured, title))).when(has(structured), structured).when(has(title), title).otherwise(others)
    origin = ladder((clash, "structured+title"), (has(structured), "structured"), (has(title), "title"), (has(others), "others"), otherwise="none")
    return F.struct(keys.alias("keys"), origin.alias("origin"), clash.alias("conflict"))


def concrete_tokens(text: ColumnOrName) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_blank(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC_TOKENS)))


def equipment_agreement(equipment_title: ColumnOrName, activity_name: ColumnOrName, activity_scope: Column) -> Column:
    """Whether the document's own words back the activity: by scope, by sibling scope, or by a concrete token."""
    own = scope_keys(equipment_title)
    sibling = F.lit(False)
    for group in SIBLINGS:
        members = F.array(*[F.lit(g) for g in group])
        sibling = sibling | (F.arrays_overlap(own, members) & F.arrays_overlap(activity_scope, members))
    return (F.size(activity_scope) == 0) | F.arrays_overlap(own, activity_scope) | sibling | F.arrays_overlap(concrete_tokens(equipment_title), concrete_tokens(activity_name))


def adjusted_score(rrf: ColumnOrName, phase: ColumnOrName, scope: ColumnOrName, generic: Column, by_rule_scope: Column) -> Column:
    factor = lambda table, x: F.coalesce(F.create_map(*[F.lit(v) for p in table.items() for v in p])[col(x)], F.lit(0.75))
    out = col(rrf) * factor(PHASE_FACTOR, phase) * factor(SCOPE_FACTOR, scope) * F.when(generic, GENERIC_FACTOR).otherwise(1.0)
    return out * F.when(by_rule_scope & (col(scope) != "match"), RULE_SCOPE_FACTOR).otherwise(1.0)


def looks_like_code(x: ColumnOrName) -> Column:
    """A document number rather than a name: digit, separator, two letters, ten characters; or a known prefix."""
    v = F.trim(text_or_blank(x))
    letters = F.length(F.regexp_replace(v, "[^\\p{L}]", ""))
    return v.rlike("(?i)^(T[0-9]{4,}|DOC_[0-9]+)") | (v.rlike("[0-9]") & v.rlike("[-_/&~]") & (letters >= 2) & (F.length(v) >= 10))

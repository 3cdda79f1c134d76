"""Inference ladders of the standard list, from structured fields first and the title after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ColumnOrName, col, contains_any, ladder, text_or_blank
from dossier.operators.listing import joined_alike
from dossier.sources.scratch import settled

FACETS = ("document_type", "discipline", "inferred_system", "sub_system", "inferred_equipment", "scope_type", "standard_title")
FIELDS = ("title", "equipment", "building", "system", "study", "others", "deliverable")
# Markers of each ladder in their order, over lower-case text with single spaces.
DELIVERABLE_TYPES = (
    ("Technical Data Sheet and Drawing", ("data sheet and drawing", "datasheet and drawing", "data sheet and characteristic curves and drawing")),
    ("Piping & Instrumentation Drawing", ("piping instrumentation", "p id", "p i diagram", "p and id")),
    ("Single Line Diagram", ("single line diagram", "sld")),
    ("Logic Diagram", ("logic diagram", "control logic")),
    ("Interlock Diagram", ("interlock diagram",)),
    ("Wiring Diagram", ("wiring diagram", "interconnection wiring")),
    ("Cable Raceway Layout", ("cable raceway",)),
    ("Cable Schedule", ("cable schedule",)),
    ("Lighting Layout", ("lighting layout",)),
    ("Grounding Layout", ("grounding", "earthing", "lightning protection")),
    ("Isometric Drawing", ("isometric", "iso drawing")),
    ("Piping Support Drawing", ("piping support",)),
    ("Hook-Up Drawing", ("hook up", "hookup")),
    ("Cause & Effect Matrix", ("cause effect", "cause and effect", "c e matrix")),
    ("General Arrangement Drawing", ("general arrangement", "general layout", "ga drawing", "arrangement drawing", "arrangement")),
    ("Layout Drawing", ("layout drawing", "layout", "plan section", "plan and section", "equipment plan")),
    ("Reinforcement Drawing", ("reinforcement", "rebar", "re bar")),
    ("Foundation Drawing", ("foundation", "footing")),
    ("Detail Drawing", ("detail", "section", "elevation", "cladding", "shop drawing", "workshop drawing", "outline drawing", "assembly drawing")),
    ("Drawing", ("drawing", "dwg")),
    ("Design Calculation", ("design calculation", "sizing calculation", "calculation sheet", "calculation")),
    ("Technical Data Sheet", ("technical data sheet", "data sheet", "datasheet")),
    ("Technical Specification", ("technical specification", "specification")),
    ("Performance Curve", ("performance curve", "curve")),
    ("System Description", ("system description", "functional description", "description")),
    ("Control Philosophy", ("control philosophy", "philosophy")),
    ("Study", ("hazop", "hazid", "sil", "study")),
    ("Survey Report", ("survey report", "investigation report")),
    ("Report", ("report", "assessment", "analysis")),
    ("Procedure", ("procedure",)),
    ("Manual", ("manual", "instruction")),
    ("Packing List", ("packing list",)),
    ("Quality Dossier", ("quality dossier",)),
    ("Certificate", ("certificate",)),
    ("Register", ("register",)),
    ("Index", ("index",)),
    ("List", ("list",)),
    ("Schedule", ("schedule",)),
    ("Plan", ("plan",)),
    ("Diagram", ("diagram",)),
    ("BOM", ("bom", "bill of material")),
    ("Dossier", ("dossier",)),
)
TITLE_TYPES = (
    ("Piping & Instrumentation Drawing", ("p id", "p i diagram", "piping instrumentation")),
    ("General Arrangement Drawing", ("general arrangement", "ga drawing")),
    ("Data Sheet", ("data sheet", "datasheet")),
    ("Technical Specification", ("technical specification", "specification")),
    ("Design Calculation", ("design calculation", "calculation")),
    ("Layout Drawing", ("layout",)),
    ("Report", ("report",)),
    ("Study", ("study",)),
    ("Procedure", ("procedure",)),
    ("Manual", ("manual",)),
    ("Drawing", ("drawing",)),
    ("List", ("list",)),
    ("Schedule", ("schedule",)),
    ("Diagram", ("diagram",)),
)
DISCIPLINES = (
    ("Civil/Structural", ("foundation", "structural", "structure", "rebar", "reinforcement", "civil", "architectural", "building", "road", "drainage", "underground", "excavation", "concrete", "cladding")),
    ("Piping", ("piping", "pipe", "isometric", "stress analysis", "support schedule", "valve list")),
    ("Instrumentation & Control", ("instrument", "i c", "control logic", "dcs", "plc", "transmitter", "analyzer", "control valve", "junction box", "loop diagram", "hook up")),
    ("Electrical", ("cable", "switchgear", "transformer", "electrical", "lighting", "grounding", "earthing", "motor control", "mcc", "ups", "battery", "relay", "short circuit", "load flow")),
    ("Process", ("heat balance", "water balance", "process flow", "pfd", "process", "hazop", "hazid", "sil", "operating philosophy")),
)
GENERAL_TYPES = ("procedure", "manual", "plan", "list")
SYSTEMS = (
    ("Electrical Power System", ("load flow", "short circuit", "motor starting", "protection", "arc flash", "harmonic", "grid")),
    ("Plant Safety System", ("hazop", "hazid", "sil", "safety")),
    ("Civil / Site Infrastructure System", ("soil", "geotechnical", "survey", "hydrology", "flood")),
    ("Plant Performance System", ("heat balance", "performance", "thermal")),
)
STUDY_MODELS = (
    ("Plant Safety Model", ("hazop", "hazid", "sil", "safety")),
    ("Electrical Network Model", ("load flow", "short circuit", "motor starting", "protection", "arc flash", "harmonic", "grid")),
    ("Site Investigation Model", ("soil", "geotechnical", "survey", "hydrology", "flood", "bathymetric", "metocean")),
    ("Plant Noise Model", ("noise",)),
    ("Air Emission Model", ("emission", "dispersion")),
    ("Plant Reliability Model", ("ram",)),
)
EPC_MARKERS = (
    "foundation", "building", "structure", "structural", "road", "drainage", "underground", "plot plan", "layout", "cable raceway", "cable tray",
    "piping arrangement", "isometric", "support", "hazop", "sil", "study", "survey", "heat balance", "water balance", "control philosophy",
    "plant operation", "design criteria",
)
VENDOR_MARKERS = (
    "datasheet", "data sheet", "technical data", "performance curve", "performance data", "vendor", "shop drawing", "o m manual",
    "operation maintenance", "factory acceptance", "fat", "package", "equipment list",
)
VENDOR_TYPES = (
    "certificate", "manual", "packing list", "performance curve", "quality dossier", "technical data sheet", "technical data sheet and drawing",
    "technical specification",
)
CIVIL_WORKS = ("foundation", "building structure", "road", "drainage", "underground", "civil works")
SUBJECTS = (
    ("Casing and Field Erection Arrangement", ("arrangement of casing field erection", "casing field erection")),
    ("Inlet Duct Arrangement", ("arrangement of inlet duct", "inlet duct arrangement")),
    ("Main Stack Field Erection Arrangement", ("arrangement of main stack field erection", "main stack field erection")),
    ("Duct Burner System General Arrangement", ("general arrangement for duct burner system",)),
    ("Duct Burner System Detail Arrangement", ("detail arrangement for duct burner system",)),
    ("Duct Burner System Fuel Gas Skid Arrangement", ("fuel gas skid arrangement for duct burner system",)),
    ("Duct Burner System Cooling Air Skid Arrangement", ("cooling air skid arrangement for duct burner system",)),
    ("Pressure Part Arrangement", ("pressure part arrangement",)),
    ("Partition Plate and Gas Baffle Arrangement", ("partition plate gas baffle", "gas baffle arrangement")),
    ("Chemical Dosing Shelter Portable Extinguisher Arrangement", ("portable extinguisher arrangement for chemical dosing shelter",)),
    ("Portable Extinguisher Arrangement", ("portable extinguisher arrangement",)),
    ("Catalyst Frame and Sealing Arrangement", ("catalyst frame sealing arrangement",)),
    ("Plan View", ("plan view",)),
    ("Section View", ("section a a", "section b b", "section c c")),
    ("Roof Floor Plan", ("roof floor plan",)),
    ("Characteristic Curve", ("characteristic curve",)),
    ("Performance Curve", ("performance curve",)),
    ("Foundation and Loading Data", ("foundation and loading data", "foundation loading data")),
)
UPPER_WORDS = (
    "AC", "ACC", "BFP", "CCWP", "CEP", "CWP", "DC", "DCS", "FAT", "GA", "GT", "GTG", "HAZOP", "HRSG", "HSE", "HVAC", "I&C", "MCC", "O&M", "P&ID",
    "SAT", "SIL", "ST", "STG", "UPS",
)
EXPANSIONS = {"CVP": "Condenser Vacuum Pump", "WBVP": "Water Box Vacuum Pump", "BOP": "Balance of Plant"}


def cell(x: ColumnOrName) -> Column:
    """Single spaces; spellings of a missing value are blank."""
    value = F.trim(F.regexp_replace(text_or_blank(x), "\\s+", " "))
    return F.when(F.lower(value).isin("nan", "none", "null", "n/a"), "").otherwise(value)


def key(x: ColumnOrName) -> Column:
    """Lower-case words of a cleaned text."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9가-힣]+", " "))


def joined(*values: Column) -> Column:
    return key(F.concat_ws(" ", *values))


def first_marked(text: Column, table, otherwise: ColumnOrName) -> Column:
    return ladder(*[(contains_any(text, words), name) for name, words in table], otherwise=otherwise)


def engineering_case(x: ColumnOrName) -> Column:
    """Capitalised words of a cleaned text; known short forms in capitals, mixed and compound words as they are."""

    def shown(w: Column) -> Column:
        rest = F.substring(w, 2, 1_000_000)
        known = F.btrim(F.upper(w), F.lit("()")).isin(*UPPER_WORDS)
        return F.when(known, F.upper(w)).when(rest.rlike("\\p{Lu}") | w.contains("&") | w.contains("/"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(rest)))

    return F.array_join(F.transform(F.split(col(x), " "), shown), " ")


def no_document(x: Column, plain: Column) -> Column:
    """Dates, notes and remarks in the place of a title; plain is the key of x."""
    short = (F.size(F.split(x, " ")) <= 2) & contains_any(plain, ("remark", "note", "date", "schedule 기준"))
    marked = x.rlike("(?iU)\\bpo\\s*기준\\b|\\bpo\\s*base(?:d)?\\b|\\b\\d{1,2}\\s*월\\s*\\d{1,2}\\s*일\\b|\\b\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}\\b|제출\\s*날짜|플기팀|구매팀")
    return (x == "") | plain.isin("-", "--", "tbd", "n a", "na", "none", "null") | marked | short


def subject_text(x: ColumnOrName) -> Column:
    """What stands after `for` in a cleaned text."""
    subject = cell(F.regexp_extract(col(x), "(?i)\\bfor\\s+(.+)$", 1))
    subject = F.regexp_replace(F.regexp_replace(subject, "^\\[|\\]$", ""), "(?i)\\s*\\([^)]*plant area[^)]*\\)\\s*", " ")
    subject = cell(F.regexp_replace(subject, "^[ _\\[\\]-]+|[ _\\[\\]-]+$", ""))
    return F.when(F.lower(col(x)).contains("for"), subject).otherwise("")


def named_subject(subject: Column, plain: Column) -> Column:
    """What a subject text names, plain being its key; blank where it names nothing."""
    full = F.create_map(*[F.lit(v) for p in EXPANSIONS.items() for v in p])[F.upper(subject)]
    return F.coalesce(full, F.when((F.length(subject) >= 3) & ~no_document(subject, plain), engineering_case(subject)), F.lit(""))


def standard_title(equipment: Column, document_type: Column, kind: Column, subject: Column) -> Column:
    """kind: the key of document_type; subject: what SUBJECTS name in the title."""
    said = lambda *v: cell(F.concat_ws(" ", *v))
    plain = once = F.concat_ws(" ", equipment, document_type)
    for word in ("Drawing", "Report", "Study", "Procedure"):
        once = F.regexp_replace(once, f"(?i)\\b({word}) {word}\\b", word)
    plain = F.when(plain.rlike("(?i)\\b(Drawing|Report|Study|Procedure) \\1\\b"), once).otherwise(plain)
    return ladder(
        (kind == "foundation drawing", said(equipment, F.when(~key(equipment).contains("foundation"), "Foundation"), F.lit("Drawing"))), (subject == "", cell(plain)),
        (kind == "general arrangement drawing", said(equipment, subject, F.lit("Drawing"))),
        ((kind == "layout drawing") & ~subject.isin("Plan View", "Section View"), said(equipment, subject, F.lit("Layout Drawing"))),
        ((kind == "technical data sheet") & subject.isin("Characteristic Curve", "Performance Curve"), said(equipment, subject)),
        (kind == "design calculation", said(equipment, subject, F.lit("Design Calculation"))), otherwise=cell(plain),
    )


def with_standard_facets(rows: DataFrame) -> DataFrame:
    """rows (FIELDS) with document_type, discipline, inferred_system, sub_system, inferred_equipment, scope_type and standard_title.

    Each distinct set of fields goes through the ladders once and its rows join
    it. Every cleaned text is a column of its own: inside the steps of a ladder it
    would be cleaned again for each marker.
    """
    kept = rows.columns
    distinct = settled(rows.select(*FIELDS).distinct())
    found = joined_alike(rows.drop(*FACETS), _facets(distinct).select(*FIELDS, *FACETS), FIELDS, distinct.count())
    return found.select(*kept, *[x for x in FACETS if x not in kept])


def _facets(rows: DataFrame) -> DataFrame:
    df = rows.withColumns({f"_{c}": cell(c) for c in FIELDS})
    c = lambda name: F.col(f"_{name}")
    filled = lambda name: c(name) != ""
    df = df.withColumns({f"_{x}_key": key(f"_{x}") for x in ("title", "equipment", "building", "study")} | {"_asked_key": joined(c("deliverable"), c("title")), "_text": joined(*[c(x) for x in FIELDS])})
    df = df.withColumns({"_for_title": subject_text("_title"), "_for_others": subject_text("_others"), "_subject": first_marked(c("title_key"), SUBJECTS, "")})
    kind = F.when(filled("deliverable"), first_marked(c("asked_key"), DELIVERABLE_TYPES, engineering_case("_deliverable"))).otherwise(first_marked(c("title_key"), TITLE_TYPES, "Document"))
    df = df.withColumns({"document_type": kind, "_for_title_key": key("_for_title"), "_for_others_key": key("_for_others")})
    df = df.withColumns({"_kind_key": key("document_type"), "_named_title": named_subject(c("for_title"), c("for_title_key")), "_named_others": named_subject(c("for_others"), c("for_others_key"))})
    general = contains_any(c("kind_key"), GENERAL_TYPES) & ~filled("equipment")
    df = df.withColumn("discipline", first_marked(c("text"), DISCIPLINES, F.when(general, "General").otherwise("Mechanical")))
    system = [(contains_any(c("title_key"), words) | (contains_any(c("study_key"), words) if name != "Plant Performance System" else F.lit(False)), name) for name, words in SYSTEMS]
    system = ladder((filled("system"), engineering_case("_system")), *system, (c("building_key") != "", "Building / Structure System"), (c("equipment_key") != "", "Equipment Package System"), (F.col("discipline") == "General", "Project General System"), otherwise="Plant General System")
    sub = ladder(*[(filled(x), engineering_case(f"_{x}")) for x in ("building", "others", "study")], otherwise="General Area")
    df = df.withColumns({"inferred_system": system, "sub_system": sub})
    others = F.when(filled("named_others"), c("named_others")).otherwise(engineering_case("_others"))
    model = first_marked(c("study_key"), STUDY_MODELS, F.concat(engineering_case("_study"), F.lit(" Model")))
    equipment = ladder(
        (filled("equipment"), engineering_case("_equipment")), (filled("building"), F.concat(engineering_case("_building"), F.lit(" Structure"))), (filled("study"), model), (filled("others"), others),
        (filled("named_title"), c("named_title")), (filled("system"), engineering_case("_system")), (F.col("inferred_system").contains("Electrical Power"), "Electrical Network Model"),
        (F.col("inferred_system").contains("Safety"), "Plant Safety Model"), (F.col("sub_system") != "General Area", F.col("sub_system")), otherwise="Plant General",
    )
    df = df.withColumn("inferred_equipment", equipment)
    df = df.withColumns({"_all": joined(c("text"), F.col("document_type"), F.col("inferred_equipment")), "_about": key(F.when(filled("equipment"), c("equipment")).otherwise(F.col("inferred_equipment")))})
    vendor = c("kind_key").isin(*VENDOR_TYPES) & (c("about") != "") & ~F.lit("plant general general area").contains(c("about")) & ~contains_any(c("all"), CIVIL_WORKS)
    marked = F.lower(c("title")).contains("(v)") | F.lower(c("title")).contains("（v）")
    scope = ladder((vendor, "Vendor"), (contains_any(c("all"), EPC_MARKERS), "EPC"), (filled("equipment") & contains_any(c("all"), VENDOR_MARKERS), "Vendor"), (marked, "Vendor"), otherwise=F.when(filled("equipment"), "Vendor").otherwise("EPC"))
    return df.withColumns({"scope_type": scope, "standard_title": standard_title(F.col("inferred_equipment"), F.col("document_type"), c("kind_key"), c("subject"))})

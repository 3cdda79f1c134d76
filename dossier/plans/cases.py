"""Fixed cases: wording worked out by hand, so that a wrong or short table can't confirm itself.

Each query puts its cases through the operator on the rows of `part`, a case for
each by its key; its SQL joins the list of expected values, which no table of the
package feeds, by case number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions import vocabulary as V
from dossier.operators import audit as A
from dossier.operators import candidates as C
from dossier.operators import filters as P
from dossier.operators import listing as L
from dossier.operators import matching as M
from dossier.operators import records as Q
from dossier.operators import registers as G
from dossier.plans.registry import Tables, query


def _text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def case_rows(t: Tables, fields: str, cases: Sequence[tuple]) -> DataFrame:
    """(p_partkey, case_id and the fields as text): each part stands for the case that its key falls to."""
    at = (F.col("p_partkey") % len(cases)).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]).cast("string") for c in cases]), at + 1)
    return t.part.select("p_partkey", at.alias("case_id"), *[pick(i).alias(f) for i, f in enumerate(fields.split())])


def expected_rows(found: Sequence) -> str:
    """SQL of the expected value of each part's case."""
    values = ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(found))
    return f"SELECT p_partkey, case_id, found FROM (SELECT p_partkey, CAST(p_partkey % {len(found)} AS INTEGER) AS case_id FROM part) JOIN (VALUES {values}) v(case_id, found) USING (case_id)"


def fixed_cases(name: str, fields: str, compute: Callable[[], Column], cases: Sequence[tuple]) -> None:
    """Register a query (p_partkey, case_id, found); the last item of each case is the expected text, the others are the named fields."""

    def make(t: Tables) -> DataFrame:
        return case_rows(t, fields, cases).select("p_partkey", "case_id", compute().cast("string").alias("found"))

    make.__name__ = name
    query(expected_rows([c[-1] for c in cases]))(make)


def _pair(x: Column) -> Column:
    return F.concat_ws("/", x["family"], x["subtype"])


fixed_cases("families_by_hand", "title", lambda: _pair(V.deliverable_type(F.lit(""), "title")), (
    ("HAZARDOUS AREA CLASSIFICATION LAYOUT", "classification/hazardous_area_classification"), ("CAPABILITY CURVES OF GTG", "curve/generator_capability_curve"), ("PUMP PERFORMANCE DATA", "curve/performance_curve"),
    ("INPUT / OUTPUT LIST", "list/io_list"), ("INSTRUMENT LIST", "list/instrument_list"), ("EQUIPMENT LIST", "list/equipment_list"), ("VALVE LIST", "list/valve_list"), ("CABLE SCHEDULE", "list/cable_schedule"), ("PAINT SCHEDULE", "schedule/schedule"),
    ("CFD REPORT", "report/cfd_report"), ("PRE-FAT REPORT", "report/pre_fat_report"), ("DESIGN REPORT", "report/design_report"), ("STUDY REPORT", "report/study_report"), ("TEST REPORT", "report/test_report"), ("SOIL REPORT", "report/report"),
    ("PAINT SPECIFICATION", "specification/painting_specification"), ("INSULATION SPECIFICATION", "specification/insulation_specification"), ("FAN SPECIFICATION", "specification/fan_specification"), ("CABLE SPECIFICATION", "specification/cable_specification"),
    ("GAS DETECTOR SPECIFICATION", "specification/gas_detector_specification"), ("PUMP SPECIFICATION", "specification/pump_specification"), ("TECHNICAL SPECIFICATIONS", "specification/technical_specification"), ("SPECIFICATION OF DOORS", "specification/specification"),
    ("TECHNICAL DATASHEET", "datasheet/technical_data_sheet"), ("DATA SHEET", "datasheet/data_sheet"), ("O&M MANUAL", "manual/operation_maintenance_manual"), ("ASSEMBLY MANUAL", "manual/assembly_manual"), ("MANUAL", "manual/manual"),
    ("SYSTEM DESCRIPTION", "description/system_description"), ("CONTROL PHILOSOPHY", "description/control_description"), ("PIPING AND INSTRUMENTATION DIAGRAM", "diagram/p_id"), ("SINGLE LINE DIAGRAM", "diagram/single_line_diagram"),
    ("POWER DISTRIBUTION DIAGRAM", "diagram/power_distribution_diagram"), ("HMI GRAPHIC DIAGRAM", "diagram/hmi_graphic_diagram"), ("CONTROL LOGIC DIAGRAM", "diagram/control_logic_diagram"), ("FUNCTIONAL LOOP DIAGRAM", "diagram/functional_loop_diagram"),
    ("CONTROL LOOP", "diagram/control_loop_diagram"), ("WIRING DIAGRAM", "diagram/wiring_diagram"), ("SCHEMATICS", "diagram/schematic_diagram"), ("BLOCK DIAGRAM", "diagram/diagram"), ("GA DRAWING", "drawing/general_arrangement_drawing"),
    ("LAYOUT", "drawing/layout_drawing"), ("OUTLINE DRAWING", "drawing/outline_drawing"), ("ISOMETRIC", "drawing/isometric_drawing"), ("DOOR DETAIL", "drawing/detail_drawing"), ("SECTION A-A", "drawing/sectional_drawing"), ("DRAWING", "drawing/drawing"),
    ("SIZING CALCULATION", "calculation/sizing_calculation"), ("DESIGN CALCULATION", "calculation/design_calculation"), ("CALCULATION SHEET", "calculation/calculation"), ("TEST PROCEDURE", "procedure/test_procedure"), ("PROCEDURE", "procedure/procedure"),
    ("DESIGN CRITERIA", "criteria/design_criteria"), ("DESIGN REQUIREMENTS", "requirements/design_requirements"), ("PLOT PLAN", "plan/plan"), ("GENERAL NOTES", "notes/general_notes"), ("3D MODEL", "model/model"), ("OPERATIONAL DATA", "data/operational_data"),
    ("", "/"),
))
fixed_cases("scopes_by_hand", "title", lambda: Q.joined(V.scope_keys("title")), (
    ("BALANCE OF PLANT piping", "bop"), ("BSDG PANEL", "bsedg"), ("CCW H/EX sizing", "ccw"), ("CONTINUOUS EMISSIONS MONITORING rack", "cems"), ("PURGE AIR line", "compressed_air"), ("JIB CRANE list", "crane_hoist"),
    ("125V DC panel", "dc_ups"), ("DISTRIBUTED CONTROL racks", "dcs"), ("TARIFF METERING panel", "electrical"), ("FUEL GAS skid", "fgp"), ("STANDPIPE detail", "fire_fighting"), ("DELUGE valve", "fire_fighting"), ("CLEAN AGENT bottle", "fire_fighting"),
    ("HYDROGEN bottle", "h2"), ("VENTILATING unit", "hvac"), ("LABORATORY bench", "lab"), ("NITROGEN bottle", "n2"), ("AUX BOILER stack", "reserve_boiler"), ("STEAM TURBINE HALL", "stg"), ("EFFLUENT basin", "wts"), ("DOOR HANDLE", ""),
))
fixed_cases("rule_scopes_by_hand", "title", lambda: Q.joined(A.rule_scope_keys("title")), (
    ("LOCAL ELECTRICAL BUILDING", "leb"), ("PIPE RACK", "piperack"), ("DISTRIBUTED CONTROL SYSTEM", "dcs"), ("CONTINUOUS EMISSION MONITORING", "cems"), ("WATER TREATMENT", "wts"), ("AUXILIARY BOILER", "reserve_boiler"),
    ("FIRE ALARM", "fire_protection"), ("STORMWATER PIT", "drainage"), ("COOLING TOWER FAN", "cooling_tower"), ("BSEDG ROOM", "bsedg"), ("PUMPED STORAGE GTX", ""),
))
fixed_cases("intents_by_hand", "kind t", lambda: Q.joined(F.when(F.col("kind") == "equipment", G.requirement_intent("t")["equipment"]).when(F.col("kind") == "systems", G.requirement_intent("t")["systems"]).when(F.col("kind") == "deliverables", G.requirement_intent("t")["deliverables"]).when(F.col("kind") == "actions", G.requirement_intent("t")["actions"]).otherwise(G.requirement_intent("t")["constraints"])), (
    ("equipment", "AIR-COOLED CONDENSER of the plant", "Air Cooled Condenser"), ("equipment", "DCS cabinets", "Distributed Control System"), ("equipment", "wastewater pit", "Water Treatment System"), ("systems", "hazardous area", "Hazardous Area"),
    ("systems", "guaranteed output", "Performance"), ("systems", "power metering", "Power Metering"), ("deliverables", "P&ID", "P&ID"), ("deliverables", "degradation factor", "Degradation Curve"), ("deliverables", "FDS", "Functional Design Specification"),
    ("deliverables", "procedure", "Procedure"), ("actions", "furnish", "submit"), ("actions", "warrant", "guarantee"), ("actions", "determine", "calculate"), ("constraints", "after COD", "post-COD"), ("constraints", "as built", "as-built"),
    ("constraints", "block #2", "block-specific"), ("constraints", "whole site", "plant overall"), ("equipment", "redundant fuel gas tests", ""),
))
fixed_cases("deliverables_by_hand", "t", lambda: F.concat_ws("|", G.extract_deliverable("t"), G.normalize_deliverable("t")), (
    ("HRSG WIRING DIAGRAM", "WIRING DIAGRAM|HRSG WIRING DIAGRAM"), ("PIPE RACK ELEVATION", "ELEVATION|PIPE RACK ELEVATION"), ("RELAY SETTINGS", "SETTINGS|RELAY SETTINGS"), ("sld", "|Single Line Diagram"), (" GA ", "|General Arrangement Drawing"),
    ("P&I drawing", "DRAWING|P&ID"), ("Curve", "CURVE|Performance Curve"), ("Paint Specification", "PAINT SPECIFICATION|Painting Specification"),
))
fixed_cases("equipment_by_hand", "t", lambda: F.concat_ws("|", G.normalize_equipment("t"), G.equipment_in("t")), (
    ("gt", "Gas Turbine Generator|"), ("WTP (new)", "Water Treatment Plant|"), ("CEP & Condenser Foundation", "Steam Turbine|Condensate Extraction Pump"), ("Silo (old)", "Silo|"), ("(none)", "(none)|"),
    ("Fuel oil pit", "Fuel oil pit|Fuel Oil System"), ("GIS ROOM", "GIS ROOM|GIS"), (None, "|"),
))
fixed_cases("phases_by_hand", "title", lambda: F.concat_ws("|", V.query_phase(F.lit(""), "title", F.lit("")), V.activity_phase("title")), (
    ("DESIGN CRITERIA", "design_criteria|design_criteria"), ("P&ID", "system_design|system_design"), ("DATASHEET", "procurement|"), ("FOUNDATION", "civil_design|civil_design"), ("HAZOP STUDY", "system_design|"), ("PLOT PLAN", "civil_design|"), ("O&M MANUAL", "manual|"),
    ("ERECTION OF STACK", "|installation"), ("VENDOR P.O", "|procurement"), ("FOB PORT", "|delivery"), ("DOOR", "|"),
))
fixed_cases("not_titles", "title", lambda: Q.flag_text(P.is_not_title("title")), (
    (None, "true"), ("  ", "true"), ("N/A", "true"), ("nan", "true"), ("TBD", "true"), ("-", "false"), ("N.A", "true"), ("PO 기준 list", "true"), ("po based plan", "true"), ("pump base", "false"), ("3월 12일 submitted drawing", "true"), ("Rev 2024-01-05 layout of pipes", "true"),
    ("Rev 12024-01-05", "false"), ("도면 제출 날짜 확인 필요", "true"), ("구매팀 확인 요청 도면", "true"), ("Remark", "true"), ("Note 1", "true"), ("General notes for piping", "false"), ("Update log", "true"), ("Schedule 기준", "true"), ("Pump Data Sheet", "false"), ("Data sheet", "false"),
))
fixed_cases("packages_by_hand", "t", lambda: L.vendor_package("t")["package"], (
    ("Gas Turbine Generator", "GT / GTG"), ("Steam Turbine Generator", "ST / STG"), ("Boiler Feed Pump", "Pump"), ("Deaerator", "Tank"), ("Instrument Air Compressor", "Air / Gas Package"), ("Fin Fan Cooler", "Boiler / Heater / Cooler"),
    ("Motor Control Center", "Electrical Major Equipment"), ("Waste Water System", "Water Treatment Package"), ("Emergency Diesel Generator", "Diesel Generator Package"), ("Cooling Tower", "Cooling Tower Package"), ("Condenser", "Condenser / CTCS"),
    ("Overhead Crane (for Block 1)", "Crane / Hoist Package"), ("MOV", "Valve Package"), ("CCTV", "Instrument / Protection Package"), ("Fiber Optic Closure", "Cable / Tray Package"), ("Elevator", "Review Needed"), (None, "Review Needed"),
))
fixed_cases("package_sections", "t", lambda: F.concat_ws("|", L.vendor_package("t")["section"], L.vendor_package("t")["status"], Q.flag_text(L.excluded_equipment("t"))), (
    ("Gas Turbine", "GT Vendor Document List|mapped_by_rule|false"), ("Valve [V]", "Valve Vendor Document List|mapped_by_rule|false"), ("HRSG", "|needs_review|true"), ("Balance of Plant (for Unit 2)", "|needs_review|true"), ("dcs", "|needs_review|true"), ("Stair", "|needs_review|false"),
))
fixed_cases("evaluation_families", "t", lambda: Q.evaluation_family("t"), (
    ("P&I Diagram", "p&id"), ("Piping & Instrument drawing", "p&id"), ("Paint Specification", "painting_specification"), ("Painting works", "painting"), ("FDN drawing", "foundation"), ("Specification", "technical_specification"), ("Data Sheet", "datasheet"),
    ("Control description", "system_description"), ("Criteria", "design_criteria"), ("Soil report", "design_report"), ("Arrg of pipes", "arrangement"), ("Outline drawing", "outline"), ("O&M book", "manual"), ("Calc note", "calculation"), ("Load study", "study"),
    ("Curves", "curve"), ("Area classification", "classification"), ("Loop diagram", "diagram"), ("Configuration", "configuration"), ("Load list", "list"), ("Logic", "logic"), ("Drawing", ""),
))
fixed_cases("query_tokens_by_hand", "document equipment", lambda: F.array_join(F.array_sort(M.query_tokens("document", "equipment")), " "), (
    ("Layout", "Heat Recovery Steam Generator", "generator heat hrsg layout recovery steam"), ("Gas turbine generator", None, "gas generator gt gtg turbine"), ("Balance of plant plan", "", "balance bop of plan plant"), ("P&ID a b", "x", "p&id"),
))
fixed_cases("alignment_phrases", "t", lambda: Q.flag_text(Q.has_phrase("t", ("ACC", "AIR COOLED CONDENSER"))), (
    ("acc fan", "true"), ("accumulator", "false"), ("Air-cooled  condenser", "true"), ("air condenser", "false"), ("R&ACC", "false"), ("fan ACC", "true"), (None, "false"),
))
fixed_cases("confirmed_rules", "scope bucket verdict", lambda: Q.flag_text(Q.rule_confirmed("scope", "bucket", "verdict")), (
    ("match", None, None, "true"), ("rule_generic", "g_safe", "", "true"), ("rule_generic", "g_weak", "generic_ok", "true"), ("rule_generic", "g_weak", "no", "false"), (None, None, None, "false"),
))
fixed_cases("asked_rows", "equipment title kind", lambda: Q.flag_text(Q.asks_model("equipment", "title", "kind")), (
    ("CEP", "CEP data sheet", "Technical Data Sheet", "true"), ("Plant General", "Layout", "Drawing", "false"), ("", "Layout", "Drawing", "false"), ("CEP", "Vendor Print Index", "Drawing", "false"), ("CEP", "Foundation", "Register", "false"), ("CEP", "Transmittal sheet", "Drawing", "false"),
))
fixed_cases("rule_scope_types", "scope keyword", lambda: Q.rule_scope_type(F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(F.split("scope", ",")), "keyword"), (
    ("acc", "layout", "scoped"), ("", "Layout for piping", "implicit_specific"), ("", "P&ID - steam", "implicit_specific"), ("", "pipe_rack", "implicit_specific"), ("", "Layout", "generic"), ("", None, "generic"),
))
fixed_cases("generic_activities", "name clean path", lambda: Q.flag_text(Q.generic_activity("name", "clean", "path")), (
    ("Mechanical Design Criteria", "", "HRSG", "true"), ("HRSG P.O", "HRSG P.O", "", "false"), ("Procurement", "", "Plant", "true"), ("Design", "", "Main Steam piping > STEAM TURBINE", "false"),
))
fixed_cases("semantic_texts", "a b", lambda: Q.semantic_text("a", "b"), (("layout", "Pump", "layout Pump"), ("layout", None, "layout"), ("layout", "  ", "layout"), ("a  b", "c", "a b c")))
fixed_cases("row_labels", "number title", lambda: Q.row_label("number", "title"), (("D-1", " Layout ", "D-1 | Layout"), (" ", "Layout", "Layout"), (None, None, ""), ("D-1", None, "D-1 | ")))
fixed_cases("spoken_numbers", "x", lambda: F.concat_ws("|", F.coalesce(T.number_or_null("x").cast("string"), F.lit("none")), T.bounded_int("x", 0, 3).cast("string"), Q.flag_text(T.is_yes("x"))), (
    ("2.5", "2.5|2|true"), (" 7 ", "7.0|3|true"), ("-1", "-1.0|0|true"), ("no", "none|0|false"), ("", "none|0|true"), (None, "none|0|true"), ("FALSE", "none|0|false"),
))
fixed_cases("last_path_levels", "path", lambda: T.last_levels("path", ("PLANT", "SITE"), 2), (("Plant > HRSG > Piping > Steam", "Piping Steam"), ("Site > Plant", ""), ("HRSG", "HRSG"), (None, "")))
fixed_cases("headed_sections", "a b", lambda: T.sections_text([("Scope", "a"), ("Text", "b")]), (("x", "y", "Scope:\nx\n\nText:\ny"), ("", "y", "Text:\ny"), (None, None, "")))
fixed_cases("scope_names", "path", lambda: G.scope_name("path"), (("/a/Site One_classified.csv", "Site One"), ("x.y_MDL.xlsx", "x.y"), ("plain", "plain"), (None, "")))
fixed_cases("hierarchies", "path", lambda: G.hierarchy("path"), ((" A >B> > C", "A > B > C"), ("", ""), (None, "")))
fixed_cases("fenced_output", "t", lambda: T.without_fence("t"), (('```json\n{"a": 1}\n```', '{"a": 1}'), ("plain", "plain"), ("```\nx", "x"), (None, "")))
fixed_cases("named_chunks", "t", lambda: F.array_join(T.chunk_ids("t"), ","), (("see a&b_chunk_12, c.d_chunk_3.", "a&b_chunk_12,c.d_chunk_3"), ("chunk_1", ""), (None, "")))
fixed_cases("longest_variants", "t", lambda: T.longest_variant("t"), (("a | b c | d e", "b c"), ("ab | cd", "ab"), ("one two", "one two"), ("x | longest | y", "longest"), (None, "")))
fixed_cases("code_like_values", "t", lambda: Q.flag_text(V.looks_like_code("t")), (("T12345", "true"), ("SAU-1234-AB", "true"), ("Pump 1", "false"), ("DOC_7", "true"), (None, "false")))
fixed_cases("cell_reasons", "index systems phases known found", lambda: M.cell_reason_of(F.col("index") == "y", F.col("systems").cast("int"), F.col("phases").cast("int"), F.col("known") == "y", F.col("found").cast("int")), (
    ("n", "1", "1", "y", "3", "structured_index_missing"), ("y", "0", "1", "y", "0", "no_system"), ("y", "1", "0", "y", "0", "no_phase"), ("y", "1", "1", "y", "2", ""), ("y", "1", "1", "n", "0", "system_absent"), ("y", "1", "1", "y", "0", "phase_gap"),
))
fixed_cases("document_scopes", "structured title others", lambda: _scope_text(V.document_scope(_keys("structured"), _keys("title"), _keys("others"))), (
    ("acc", "hrsg", "", "acc|hrsg;structured+title;true"), ("acc", "acc|bop", "gtg", "acc;structured;false"), ("", "hrsg", "gtg", "hrsg;title;false"), ("", "", "gtg", "gtg;others;false"), ("", "", "", ";none;false"),
))
fixed_cases("agreeing_equipment", "title activity scope", lambda: Q.flag_text(V.equipment_agreement("title", "activity", _keys("scope"))), (
    ("HRSG casing", "anything", "", "true"), ("HRSG casing", "erection", "hrsg", "true"), ("Door", "erection", "hrsg", "false"), ("Deaerator door", "Deaerator erection", "hrsg", "true"), ("System drawing", "System design", "hrsg", "false"),
))


def _keys(c: str) -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\|"))


def _scope_text(x: Column) -> Column:
    return F.concat_ws(";", Q.joined(x["keys"]), x["origin"], Q.flag_text(x["conflict"]))


#: A sheet with titles only, one with both columns and a repeated header, one without a header.
SHEET_ROWS = (
    ("one", 1, ["Register"]), ("one", 2, ["No", "Title"]), ("one", 3, ["1", " Layout "]), ("one", 4, ["2", "title"]), ("one", 5, ["3", ""]), ("two", 1, ["DOC NO", "x", "Document Title"]), ("two", 2, ["D-1", "", "Pump list"]), ("two", 3, ["D-2"]),
    ("two", 4, ["DOC NO", "x", "Document Title"]), ("three", 1, ["a", "b"]), ("three", 2, ["c", "d"]), ("late", 11, ["Title"]), ("late", 12, ["Never"]),
)


@query("SELECT p_partkey, sheet, row, document_no, title || ' ' || p_partkey AS title FROM part, (VALUES ('one', 3, '', 'Layout'), ('two', 2, 'D-1', 'Pump list')) v(sheet, row, document_no, title)")
def register_titles(t: Tables) -> DataFrame:
    """Every part is a register of three sheets; its titles carry its key."""
    from dossier.sources.office import register_titles as titles

    own = lambda v: F.concat(F.lit(v.rstrip() + " "), F.col("p_partkey").cast("string")) if v.strip() in ("Layout", "Pump list") else F.lit(v)
    sheets = [F.struct(F.lit(sheet).alias("sheet"), F.lit(row).alias("row"), F.array(*[own(v) for v in cells]).alias("cells")) for sheet, row, cells in SHEET_ROWS]
    cells = t.part.select(F.col("p_partkey").cast("string").alias("source_file"), F.explode(F.array(*sheets)).alias("r")).select("source_file", "r.*")
    return titles(cells).select(F.col("source_file").cast("long").alias("p_partkey"), "sheet", "row", "document_no", "title")


#: deliverable, equipment, system, building; whether a model is asked.
PLACED = (("Layout", "Pump", None, None, "false"), (" ", "Pump", None, None, "true"), ("Layout", "", " ", None, "true"), ("Layout", "SAU-1234-AB", None, None, "true"))


@query(expected_rows([c[-1] for c in PLACED]) + " WHERE found = 'true'")
def model_candidates(t: Tables) -> DataFrame:
    """Only candidates that rules couldn't place go to a model."""
    return C.needs_model(case_rows(t, "deliverable equipment system building", PLACED)).select("p_partkey", "case_id", F.lit("true").alias("found"))


#: title, equipment, building, system, study, others, deliverable; then type, discipline, system, sub-system, equipment, scope and standard title.
STANDARD_ROWS = (
    (("Pump Layout", None, None, None, None, None, None), "Layout Drawing|Mechanical|Plant General System|General Area|Plant General|EPC|Plant General Layout Drawing"),
    (("Any", "HRSG casing", None, "main steam", None, None, "Datasheet"), "Technical Data Sheet|Mechanical|Main Steam|General Area|HRSG Casing|Vendor|HRSG Casing Technical Data Sheet"),
    (("Any", None, "control building", None, None, None, "Foundation"), "Foundation Drawing|Civil/Structural|Building / Structure System|Control Building|Control Building Structure|EPC|Control Building Structure Foundation Drawing"),
    (("Short circuit study", None, None, None, "Short circuit", None, None), "Study|Electrical|Electrical Power System|Short Circuit|Electrical Network Model|EPC|Electrical Network Model Study"),
    (("Manual for CVP", None, None, None, None, None, None), "Manual|General|Project General System|General Area|Condenser Vacuum Pump|Vendor|Condenser Vacuum Pump Manual"),
    (("Inlet duct arrangement", "ACC", None, "nan", None, None, "GA drawing"), "General Arrangement Drawing|Mechanical|Equipment Package System|General Area|ACC|Vendor|ACC Inlet Duct Arrangement Drawing"),
)


@query(expected_rows([found for _, found in STANDARD_ROWS]))
def standard_ladders_by_hand(t: Tables) -> DataFrame:
    from dossier.operators.standard_list import with_standard_facets

    names = ("document_type", "discipline", "inferred_system", "sub_system", "inferred_equipment", "scope_type", "standard_title")
    df = case_rows(t, "title equipment building system study others deliverable", [row for row, _ in STANDARD_ROWS])
    return with_standard_facets(df).select("p_partkey", "case_id", F.concat_ws("|", *names).alias("found"))


@query("SELECT DISTINCT p_name, 16 AS size, true AS same FROM part")
def embedding_of_equal_titles(t: Tables) -> DataFrame:
    """Each distinct title is embedded once, whatever stands around it; a title and itself have cosine 1."""
    from dossier.operators.providers import HashEmbedder, concept_similarity, embed_texts

    titles = t.part.select("p_name").distinct().withColumn("other", F.concat(F.lit(" "), "p_name", F.lit(" ")))
    vectors = embed_texts(titles, "p_name", HashEmbedder(16)).select("p_name", F.size("vector").alias("size"))
    alike = concept_similarity(titles, "p_name", "other", HashEmbedder(16)).select("p_name", (F.round("concept_similarity", 6) == 1).alias("same"))
    return vectors.join(alike, "p_name")


@query("SELECT page_id, true AS bounded, true AS gapless FROM pages")
def page_chunk_bounds(t: Tables) -> DataFrame:
    """No chunk of a page exceeds the budget, and their numbers have no gap; a page without visible text has none."""
    from dossier.operators.chunking import chunk_paragraphs, html_text

    chunks = chunk_paragraphs(t.pages.select("page_id", html_text("html").alias("text")), "page_id", "text", 64)
    checked = chunks.groupBy(F.col("doc_id").alias("page_id")).agg((F.max("token_count") <= 64).alias("bounded"), ((F.max("chunk_index") + 1 == F.count(F.lit(1))) & (F.min("chunk_index") == 0)).alias("gapless"))
    return t.pages.select("page_id").join(checked, "page_id", "left").fillna(True, ["bounded", "gapless"])

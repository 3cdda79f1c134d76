"""The fixed tables against titles written by hand for each key."""

from pyspark.sql import functions as F

from dossier.functions import vocabulary as V
from dossier.operators import audit as A
from dossier.operators import matching as M
from dossier.operators import registers as G

SCOPES = {
    "acc": ["Air cooled condenser fan", "COND AIR EXT skid"], "bop": ["BALANCE OF PLANT piping"], "bsedg": ["Blackstart diesel generator data", "BSDG PANEL"], "ccw": ["CCW H/EX sizing", "FIN FAN COOLER"],
    "cems": ["CONTINUOUS EMISSIONS MONITORING rack"], "compressed_air": ["PURGE AIR line", "COMP AIR receiver"], "condensate": ["CEP motor"], "crane_hoist": ["JIB CRANE list"], "dc_ups": ["125V DC panel", "DIRECT CURRENT board"],
    "dcs": ["DISTRIBUTED CONTROL racks"], "electrical": ["TARIFF METERING panel", "SMALL POWER plan"], "feedwater": ["FW PIPING stress", "FWP motor"], "fgp": ["FUEL GAS skid", "GAS CONDITIONING"],
    "fire_fighting": ["STANDPIPE detail", "DELUGE valve", "CLEAN AGENT bottle", "FOAM STATION"], "gtg": ["GAS TURBINE hall"], "gsut_uat": ["UNIT AUXILIARY TRANSFORMER", "GSUT bay"], "h2": ["HYDROGEN bottle"],
    "hrsg": ["HEAT RECOVERY STEAM GENERATOR casing"], "hvac": ["VENTILATING unit"], "lab": ["LABORATORY bench"], "mv_lv": ["MV SWGR room", "MOTOR CONTROL CENTER"], "n2": ["NITROGEN bottle"], "reserve_boiler": ["AUX BOILER stack"],
    "sampling": ["SAMPLING EQUIP rack"], "service_water": ["RAW WATER tank", "SWS line"], "steam": ["MAIN STEAM line"], "stg": ["STEAM TURBINE hall"], "wts": ["SEWAGE pit", "EFFLUENT basin", "DM WATER tank"],
}
FAMILIES = {
    ("classification", "hazardous_area_classification"): "HAZARDOUS AREA CLASSIFICATION LAYOUT", ("curve", "generator_capability_curve"): "CAPABILITY CURVES OF GTG", ("curve", "performance_curve"): "PUMP PERFORMANCE DATA",
    ("list", "io_list"): "INPUT / OUTPUT LIST", ("list", "instrument_list"): "INSTRUMENT LIST", ("list", "equipment_list"): "EQUIPMENT LIST", ("list", "valve_list"): "VALVE LIST", ("list", "cable_schedule"): "CABLE SCHEDULE", ("schedule", "schedule"): "PAINT SCHEDULE",
    ("report", "cfd_report"): "CFD REPORT", ("report", "pre_fat_report"): "PRE-FAT REPORT", ("report", "design_report"): "DESIGN REPORT", ("report", "study_report"): "STUDY REPORT", ("report", "test_report"): "TEST REPORT", ("report", "report"): "SOIL REPORT",
    ("specification", "painting_specification"): "PAINT SPECIFICATION", ("specification", "insulation_specification"): "INSULATION SPECIFICATION", ("specification", "fan_specification"): "FAN SPECIFICATION",
    ("specification", "drain_pump_specification"): "CONDENSATE DRAIN PUMP SPECIFICATION", ("specification", "scr_specification"): "TECHNICAL SPECIFICATION FOR SCR", ("specification", "cable_specification"): "CABLE SPECIFICATION",
    ("specification", "gas_detector_specification"): "GAS DETECTOR SPECIFICATION", ("specification", "pump_specification"): "PUMP SPECIFICATION", ("specification", "technical_specification"): "TECHNICAL SPECIFICATIONS", ("specification", "specification"): "SPECIFICATION OF DOORS",
    ("datasheet", "technical_data_sheet"): "TECHNICAL DATASHEET", ("datasheet", "data_sheet"): "DATA SHEET", ("manual", "operation_maintenance_manual"): "O&M MANUAL", ("manual", "assembly_manual"): "ASSEMBLY MANUAL", ("manual", "manual"): "MANUAL",
    ("description", "system_description"): "SYSTEM DESCRIPTION", ("description", "control_description"): "CONTROL PHILOSOPHY", ("diagram", "p_id"): "PIPING AND INSTRUMENTATION DIAGRAM", ("diagram", "single_line_diagram"): "SINGLE LINE DIAGRAM",
    ("diagram", "power_distribution_diagram"): "POWER DISTRIBUTION DIAGRAM", ("diagram", "hmi_graphic_diagram"): "HMI GRAPHIC DIAGRAM", ("diagram", "control_logic_diagram"): "CONTROL LOGIC DIAGRAM", ("diagram", "functional_loop_diagram"): "FUNCTIONAL LOOP DIAGRAM",
    ("diagram", "control_loop_diagram"): "CONTROL LOOP", ("diagram", "wiring_diagram"): "WIRING DIAGRAM", ("diagram", "schematic_diagram"): "SCHEMATICS", ("diagram", "diagram"): "BLOCK DIAGRAM", ("drawing", "general_arrangement_drawing"): "GA DRAWING",
    ("drawing", "layout_drawing"): "LAYOUT", ("drawing", "outline_drawing"): "OUTLINE DRAWING", ("drawing", "isometric_drawing"): "ISOMETRIC", ("drawing", "detail_drawing"): "DOOR DETAIL", ("drawing", "sectional_drawing"): "SECTION A-A", ("drawing", "drawing"): "DRAWING",
    ("calculation", "sizing_calculation"): "SIZING CALCULATION", ("calculation", "design_calculation"): "DESIGN CALCULATION", ("calculation", "calculation"): "CALCULATION SHEET", ("procedure", "test_procedure"): "TEST PROCEDURE", ("procedure", "procedure"): "PROCEDURE",
    ("criteria", "design_criteria"): "DESIGN CRITERIA", ("requirements", "design_requirements"): "DESIGN REQUIREMENTS", ("plan", "plan"): "PLOT PLAN", ("notes", "general_notes"): "GENERAL NOTES", ("model", "model"): "3D MODEL",
    ("data", "operational_data"): "OPERATIONAL DATA", ("data", "data"): "DATA OF DOORS",
}


def each(spark, titles, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_every_scope_is_named_by_its_titles(spark):
    assert [k for k, _ in V.SCOPES] == list(SCOPES)
    pairs = [(k, t) for k, titles in SCOPES.items() for t in titles]
    assert {t: k in keys for (k, t), keys in zip(pairs, each(spark, [t for _, t in pairs], V.scope_keys("t")))} == {t: True for _, t in pairs}
    assert each(spark, ["STEAM TURBINE HALL"], V.scope_keys("t")) == [["stg"]]


def test_every_family_is_named_by_its_title(spark):
    assert [(f, s) for f, s, _ in V.FAMILIES] == list(FAMILIES)
    found = each(spark, list(FAMILIES.values()), V.deliverable_type(F.lit(""), "t"))
    assert [tuple(x) for x in found] == list(FAMILIES)


RULE_SCOPES = {
    "acc": ["COND AIR EXT PUMP"], "ccr": ["CENTRAL CONTROL BUILDING", "CONTROL ROOMS"], "hrsg": ["HRSG-1"], "gtg": ["GT HALL", "GAS TURBINES"], "leb": ["LOCAL ELECTRICAL BUILDING"], "piperack": ["PIPE RACK"], "pump": ["SUMP PUMP"],
    "stg": ["ST HALL"], "tank": ["WATER TANKS"], "dcs": ["DISTRIBUTED CONTROL SYSTEM"], "cems": ["CONTINUOUS EMISSION MONITORING"], "wts": ["WATER TREATMENT"], "reserve_boiler": ["AUXILIARY BOILER"], "bop": ["BALANCE OF PLANT"], "fgp": ["FUEL GAS LINE"],
    "fire_protection": ["FIRE ALARM", "FIRE BRIGADE", "FM-200 BOTTLE", "STAND PIPE"], "drainage": ["STORMWATER PIT", "SANITARY WORKS"], "cooling_tower": ["COOLING TOWER FAN"], "bsedg": ["BSEDG ROOM"], "ccwp": ["CCWP MOTOR"], "bfp": ["BFP MOTOR"], "cep": ["CEP MOTOR"],
}


def test_every_rule_scope_is_named_by_its_titles(spark):
    assert {k for k, _ in A.RULE_SCOPE_PHRASES} | set(A.RULE_SCOPES) == set(RULE_SCOPES) | {"gt", "st"}
    assert set(M.EXCLUSIVE_SYSTEMS) <= set(RULE_SCOPES)
    pairs = [(k, t) for k, titles in RULE_SCOPES.items() for t in titles]
    assert {t: k in keys for (k, t), keys in zip(pairs, each(spark, [t for _, t in pairs], A.rule_scope_keys("t")))} == {t: True for _, t in pairs}
    assert each(spark, ["PUMPED STORAGE GTX"], A.rule_scope_keys("t")) == [[]]


def test_fire_is_kept_from_drainage(spark):
    def guard(query, rule):
        side = lambda t, **more: F.struct(F.lit("drawing").alias("family"), F.lit("layout_drawing").alias("subtype"), A.rule_scope_keys(F.lit(t)).alias("scope"), A.free_tokens(F.lit(t)).alias("tokens"), *[F.lit(v).alias(k) for k, v in more.items()])
        return spark.range(1).select(M.guard_reason(side(query), side(rule, specific=False)).alias("g")).first()["g"]

    assert guard("FIRE ALARM LAYOUT", "STORMWATER DRAINAGE LAYOUT") == "scope_mismatch"
    assert guard("CCR FIRE ALARM LAYOUT", "CCR STORMWATER DRAINAGE LAYOUT") == "system_scope_conflict"
    assert guard("CCR FIRE ALARM LAYOUT", "CCR FIRE FIGHTING LAYOUT") == ""


INTENT = {
    "AIR-COOLED CONDENSER of the plant": ("equipment", "Air Cooled Condenser"), "DCS cabinets": ("equipment", "Distributed Control System"), "CEMS house": ("equipment", "Continuous Emission Monitoring System"), "wastewater pit": ("equipment", "Water Treatment System"),
    "hazardous area": ("systems", "Hazardous Area"), "guaranteed output": ("systems", "Performance"), "emission monitoring": ("systems", "Emission Monitoring"), "power metering": ("systems", "Power Metering"), "waste water": ("systems", "Waste Water Treatment"),
    "P&ID": ("deliverables", "P&ID"), "specification": ("deliverables", "Technical Specification"), "performance correction curves": ("deliverables", "Performance Correction Curve"), "correction curves": ("deliverables", "Performance Curve"), "FDS": ("deliverables", "Functional Design Specification"),
    "valve list": ("deliverables", "List"), "calculations": ("deliverables", "Calculation"), "procedure": ("deliverables", "Procedure"), "O&M": ("deliverables", "Manual"), "logic diagrams": ("deliverables", "Control Logic Diagram"),
    "furnish": ("actions", "submit"), "develop": ("actions", "prepare"), "determine": ("actions", "calculate"), "warrant": ("actions", "guarantee"), "approve": ("actions", "review"),
    "after COD": ("constraints", "post-COD"), "post-COD": ("constraints", "post-COD"), "long-term": ("constraints", "long-term"), "as built": ("constraints", "as-built"), "block #2": ("constraints", "block-specific"), "whole site": ("constraints", "plant overall"),
}


def test_every_kind_of_intent(spark):
    assert [len(G.INTENT[k]) for k in ("equipment", "systems", "deliverables", "actions", "constraints")] == [7, 5, 24, 5, 5]
    found = each(spark, list(INTENT), G.requirement_intent("t"))
    assert {t: key in x[kind] for (t, (kind, key)), x in zip(INTENT.items(), found)} == {t: True for t in INTENT}
    assert each(spark, ["listing of redundant capacity tests, fuel gas"], G.requirement_intent("t")) == [([], [], [], [], [])]


def test_deliverable_and_equipment_words(spark):
    assert each(spark, ["HRSG WIRING DIAGRAM", "HAZARDOUS AREA CLASSIFICATION", "PIPE RACK ELEVATION", "RELAY SETTINGS", "PUMP"], G.extract_deliverable("t")) == ["WIRING DIAGRAM", "HAZARDOUS AREA CLASSIFICATION", "ELEVATION", "SETTINGS", ""]
    assert each(spark, ["sld", " GA ", "P&I drawing", "Curve", "Other"], G.normalize_deliverable("t")) == ["Single Line Diagram", "General Arrangement Drawing", "P&ID", "Performance Curve", "Other"]
    assert each(spark, ["GA", "ELEVATION", "P&I DRAWING", "CURVES"], V.deliverable_type("t", F.lit(""))) == [("drawing", "general_arrangement_drawing"), ("drawing", "drawing"), ("diagram", "p_id"), ("curve", "performance_curve")]
    assert each(spark, ["gt", "WTP (new)", "CEP & Condenser Foundation", "Silo (old)", "(none)", None], G.normalize_equipment("t")) == ["Gas Turbine Generator", "Water Treatment Plant", "Steam Turbine", "Silo", "(none)", ""]
    assert each(spark, ["STEAM TURBINE & GENERATOR HALL", "Fuel oil pit", "GIS ROOM", "DOOR"], G.equipment_in("t")) == ["Steam Turbine & Generator", "Fuel Oil System", "GIS", ""]
    assert each(spark, ["Steam Turbine", "Cooling Water Package", "Door"], G.equipment_short("t")) == ["STG", "CCWP", "Door"]
    assert each(spark, ["PAINT SPECIFICATION", "CAPABILITY CURVES"], G.refine_deliverable(F.lit(""), "t")) == ["PAINT SPECIFICATION", "CAPABILITY CURVES"]

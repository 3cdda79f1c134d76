"""The ladders of the standard list by hand: structured fields come before the title."""

from dossier.operators import standard_list as B

NAMES = ("document_type", "discipline", "inferred_system", "sub_system", "inferred_equipment", "scope_type", "standard_title")
# title, equipment, building, system, study, others, deliverable
ROWS = [
    (("Pump Layout", None, None, None, None, None, None), ("Layout Drawing", "Mechanical", "Plant General System", "General Area", "Plant General", "EPC", "Plant General Layout Drawing")),
    (("Any", "HRSG casing", None, "main steam", None, None, "Datasheet"), ("Technical Data Sheet", "Mechanical", "Main Steam", "General Area", "HRSG Casing", "Vendor", "HRSG Casing Technical Data Sheet")),
    (("Any", None, "control building", None, None, None, "Foundation"), ("Foundation Drawing", "Civil/Structural", "Building / Structure System", "Control Building", "Control Building Structure", "EPC", "Control Building Structure Foundation Drawing")),
    (("Short circuit study", None, None, None, "Short circuit", None, None), ("Study", "Electrical", "Electrical Power System", "Short Circuit", "Electrical Network Model", "EPC", "Electrical Network Model Study")),
    (("Manual for CVP", None, None, None, None, None, None), ("Manual", "General", "Project General System", "General Area", "Condenser Vacuum Pump", "Vendor", "Condenser Vacuum Pump Manual")),
    (("Inlet duct arrangement", "ACC", None, "nan", None, None, "GA drawing"), ("General Arrangement Drawing", "Mechanical", "Equipment Package System", "General Area", "ACC", "Vendor", "ACC Inlet Duct Arrangement Drawing")),
]


def test_ladders(spark):
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(ROWS)], "i int, " + ", ".join(f"{c} string" for c in ("title", "equipment", "building", "system", "study", "others", "deliverable")))
    out = B.with_standard_facets(df).orderBy("i").collect()
    assert [tuple(r[c] for c in NAMES) for r in out] == [want for _, want in ROWS]

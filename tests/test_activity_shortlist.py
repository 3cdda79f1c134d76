"""A document's phase restricts its activities, and boosts steer its query."""

from pyspark.sql import functions as F

from dossier.functions import vocabulary as V
from dossier.operators import retrieval as R


def test_phase_buckets(spark):
    phases = ["procurement", "system_design", "delivery", "installation", ""]
    asked = {1: "manual", 2: "delivery", 3: "", 4: "commissioning", 5: "design_drawing"}
    rows = [(q, phase, i, a, float(10 - i), float(i)) for q, phase in asked.items() for i, a in enumerate(phases)]
    pairs = spark.createDataFrame(rows, "query_id int, query_phase string, doc_id int, activity_phase string, a_score double, b_score double")
    out = R.activity_shortlist(pairs, 50, 10).collect()
    kept = {q: {r["doc_id"] for r in out if r["query_id"] == q} for q in asked}
    assert kept == {1: {0, 2, 3}, 2: {0, 2}, 3: {0, 1, 2, 3, 4}, 4: {0, 1, 2, 3, 4}, 5: {1}}  # no bucket and an empty one keep all
    only = next(r for r in out if r["query_id"] == 5)
    assert (only["a_rank"], only["b_rank"], only["rank"]) == (2, 4, 1)  # ranks of all activities


def test_activity_query(spark):
    words = lambda *v: F.array(*[F.lit(x) for x in v])
    ask = lambda *a: spark.range(1).select(V.activity_query(*[F.lit(x) for x in a[:4]], *a[4:]).alias("q")).first()["q"]
    assert ask("Pump", " ", "GA", "T") == "Pump General Arrangement Drawing T"
    assert ask("Pump", "Air", "Layout", "T", words("FOB")) == "Pump Air Layout Drawing T Layout Arrangement Drawing"  # the deliverable's boost comes first
    assert ask("", "", "", "T", words("pof", "x", " Fob ")) == "T P.O Procurement finish transportation delivery FOB"
    assert ask("", None, "", "T", words("x")) == "T"
    assert [len(x) for x in (V.PHASE_BUCKETS, V.DELIVERABLE_BOOST, V.KEYWORD_BOOST)] == [8, 4, 9]

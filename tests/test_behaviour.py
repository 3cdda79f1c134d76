"""Behaviours that hold beyond the driver tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates as D
from dossier.functions import text as T
from dossier.functions import vocabulary as V
from dossier.operators import candidates as C
from dossier.operators import evaluation as E
from dossier.operators import filters as P
from dossier.operators import listing as L
from dossier.operators import matching as M
from dossier.operators import providers as X
from dossier.operators import reporting as R
from dossier.sources import files as S
from dossier.sources import office as O
from dossier.streaming import resume


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [
        ("start+4W<=FA<=start+6W", (True, "start", 28, 42, None, None)),
        ("start-4M-2M<=FA<=start-4M", (True, "start", -180, -120, None, None)),
        ("start+8W<=FA<=FC<=start+20W", (True, "start", 56, 140, 56, 140)),
        ("start-3M<=FC<=start-1M", (True, "start", None, None, -90, -30)),
        ("start<=FA<=start+2M", (True, "start", 0, 60, None, None)),
        ("Finish + 0.5W =< FA =< finish+1W", (True, "finish", 4, 7, None, None)),
        ("start+1W<=FA<=start+2W\nsecond", (True, "start", 7, 14, None, None)),
        ("-", (False, "start", None, None, None, None)),
        ("", (False, "start", None, None, None, None)),
    ],
)
def test_formula(spark, formula, expected):
    got = one(spark, D.parse_validation_time("f"), f=formula)
    assert tuple(got) == expected


def test_range_of_a_joint_formula_keeps_the_gap(spark):
    df = spark.createDataFrame([("start+2W<=FA<=FC<=start+12W", dt.date(2020, 1, 1), "FA")], "f string, a date, s string").withColumn("p", D.parse_validation_time("f"))
    r = D.with_date_range(df, "p", "a", "s").first()
    assert r["fa_recommended"] == dt.date(2020, 2, 19) and r["fc_earliest"] == r["fa_recommended"] + dt.timedelta(days=21)
    moved = D.with_date_range(df, "p", "a", "s", F.lit(dt.date(2021, 1, 1))).first()
    assert moved["start_anchored"] and moved["fa_earliest"] == dt.date(2021, 1, 1)
    assert moved["fa_latest"] - moved["fa_earliest"] == r["fa_latest"] - r["fa_earliest"]
    clamped = D.with_date_range(df, "p", "a", "s", F.lit(dt.date(2020, 2, 1))).first()
    assert not clamped["start_anchored"] and clamped["floored_fields"] == ["fa_earliest"] and clamped["fa_earliest"] == dt.date(2020, 2, 1)


def test_template_shift(spark):
    shift = one(spark, D.start_shift(F.lit("2024-03-01")))
    assert shift == 6210 and dt.date(2007, 5, 1) + dt.timedelta(days=shift) == dt.date(2024, 5, 1)


def test_abbreviations_chain_longest_first(spark):
    rules = [("GT", "GAS TURBINE"), ("GTG", "GT GENERATOR"), ("GAS", "NATURAL GAS")]
    assert one(spark, T.expand_abbreviations("t", rules), t="GTG pump, gtx") == "GAS TURBINE GENERATOR pump, gtx"


def test_variants_and_lists(spark):
    assert one(spark, T.longest_variant("t"), t="HRSG | HEAT RECOVERY | STEAM GENERAT") == "HEAT RECOVERY"
    assert one(spark, T.split_list("t"), t=" a; b\nc,, ") == ["a", "b", "c"]
    assert one(spark, T.phrase_query(F.array(F.lit("a b"), F.lit("c")))) == '"a b" OR "c"'
    assert one(spark, T.fixed(F.lit(0.0))) == "" and one(spark, T.fixed(F.lit(0.5))) == "0.5000"
    assert one(spark, T.chunk_ids("t"), t="x:p1:A_chunk_000012(score=1), B-1_chunk_3") == ["A_chunk_000012", "B-1_chunk_3"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("[P] HRSG - GA DRAWING (CrossEncoder: 1.2500 / BM25: 0.9000 / RRF: 0.0320)", (1.25, "", "HRSG", "GA DRAWING")),
        ("[P] T12-34 - HRSG_GA DRAWING (Semantic: 0.9100 / CrossEncoder: 2.0)", (0.91, "T12-34", "HRSG", "HRSG GA DRAWING")),
        ("PLAIN TITLE", (0.0, "", "", "PLAIN TITLE")),
        ("X (CrossEncoder: -1.5)", (0.0, "", "", "X")),
    ],
)
def test_display_strings(spark, raw, expected):
    assert tuple(one(spark, C.parse_display("t"), t=raw)) == expected


def test_scopes_and_statuses(spark):
    assert one(spark, V.scope_keys("t"), t="GT enclosure & UPS") == ["dc_ups", "gtg"]
    assert one(spark, V.scope_keys("t"), t="GTX UPSTREAM") == []
    lists = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    status = lambda q, a: one(spark, V.scope_status(lists(*q), lists(*a)))
    assert status([], ["acc"]) == "query_unscoped" and status(["acc"], []) == "activity_unscoped"
    assert status(["hvac"], ["hvac"]) == "match" and status(["hvac", "gtg"], ["hvac"]) == "discipline_only" and status(["acc"], ["gtg"]) == "mismatch"
    assert one(spark, V.equipment_agreement(F.lit("CONDENSATE PUMP"), F.lit("x"), lists("acc")))
    scope = one(spark, V.document_scope(lists("wts"), lists("fire_fighting"), lists()))
    assert scope["keys"] == ["fire_fighting", "wts"] and scope["conflict"]


def test_noise_and_pages(spark):
    long = "The contractor shall submit a general arrangement drawing of the condenser and all of its supports " * 2
    rows = [("a", [1, 2], "text", ["x"], long), ("b", [3], "toc", None, long), ("c", [9], "text", ["document_index"], long), ("d", [2], "text", None, "short"), ("e", [2], "text", None, "1 2 3 4 5 6 7 8 9 " * 12)]
    df = spark.createDataFrame(rows, "chunk_id string, page_num array<int>, chunk_type string, label array<string>, text string")
    assert [r["chunk_id"] for r in P.without_noise(df).collect()] == ["a"]
    assert [r["chunk_id"] for r in df.filter(P.touches_pages("page_num", 2, 3)).orderBy("chunk_id").collect()] == ["a", "b", "d", "e"]
    kept, rejected = P.split_rows(df, F.col("chunk_id") == "a")
    assert kept.count() == 4 and json.loads(P.rejection(rejected, "r").first()["payload"])["chunk_id"] == "a"


def test_schedulable_passes_through_without_columns(spark):
    df = spark.createDataFrame([("selected", "accepted"), ("backup", "accepted"), ("selected", "rejected")], "candidate_selection_status string, candidate_status string")
    assert P.schedulable(df).count() == 1 and P.schedulable(df.select(F.lit(1))).count() == 3


def test_title_merge_keeps_order(spark):
    rows = [(1, "Pump  Layout", "B"), (2, "pump layout", "A"), (3, "PUMP LAYOUT", "B"), (4, " ", "C")]
    r = L.merge_titles(spark.createDataFrame(rows, "pos int, title string, source string"), "title", "pos", {"source": " | "}).collect()
    assert len(r) == 1 and r[0]["title"] == "Pump  Layout" and r[0]["source"] == "B | A" and r[0]["n_rows"] == 3


def test_numbers_are_gapless(spark):
    out = L.numbered(spark.range(1000).repartition(7).withColumn("k", -F.col("id")), [F.asc("k")])
    assert [r["no"] for r in out.orderBy("k").collect()] == list(range(1, 1001))


def test_metric_conventions(spark):
    a = F.array(F.lit(1), F.lit(2))
    none = F.array().cast("array<int>")
    s = lambda t, p, **k: [one(spark, c) for c in list(E.set_scores(t, p, **k).values())[1:4]]
    assert s(a, none) == [None, 0.0, None] and s(a, none, empty_prediction_is_right=True) == [1.0, 0.0, 0.0]
    assert s(none, none) == [1.0, None, None]


def test_threshold_default(spark):
    assert R.suggested_threshold(spark.createDataFrame([(0.5,), (0.1,)], "v double"), "v").first()["tau"] == 0.7
    assert R.suggested_threshold(spark.createDataFrame([(0.45,), (0.5,), (0.8,), (0.85,)], "v double"), "v").first()["tau"] == 0.65


def test_best_rule_prefers_exact_specifications(spark):
    rows = [(1, 1, 1, 0.9, 1.0, "", "specification", "datasheet", False, "FA"), (1, 2, 2, 0.5, 1.0, "", "specification", "specification", True, "SKIP"), (1, 3, 3, 0.4, 1.0, "", "specification", "specification", True, "FA"), (2, 4, 1, 0.9, 1.0, "scope_mismatch", "", "", False, "FA")]
    df = spark.createDataFrame(rows, "query_id int, rule_id int, priority int, final_score double, token_score double, guard string, query_family string, rule_family string, subtype_ok boolean, sub_type string")
    assert {r["query_id"]: r["rule_id"] for r in M.best_rule(df).collect()} == {1: 3, 2: None}


def test_workbook_register(spark, tmp_path):
    sheet = [["My register"], ["Document No", "x", "Title"], ["A-1", "", "Pump <layout> & more"], ["Document No", "x", "Title"], ["", "", "Fan"], ["A-3", "", ""]]
    (tmp_path / "reg.xlsx").write_bytes(O.workbook_bytes({"One": sheet, "No header": [["a", "b"]]}))
    (tmp_path / "~$reg.xlsx").write_bytes(b"lock")
    (tmp_path / "abbreviations.xlsx").write_bytes(O.workbook_bytes({"x": sheet}))
    rows = O.register_titles(O.workbooks(spark, str(tmp_path))).orderBy("row").collect()
    assert [(r["source_file"], r["sheet"], r["document_no"], r["title"]) for r in rows] == [("reg.xlsx", "One", "A-1", "Pump <layout> & more"), ("reg.xlsx", "One", "", "Fan")]
    guide = [["1", "W1", "Design"], ["Activity", "A10", "Pump layout (NTP + 3M)", "2007-05-01 00:00:00", "01-Jun-07*"], ["?", "x", "y"]]
    (tmp_path / "guide").mkdir()
    (tmp_path / "guide" / "g.xlsx").write_bytes(O.workbook_bytes({"S": guide}))
    r = O.guide_schedule(O.workbooks(spark, str(tmp_path / "guide"))).orderBy("row").collect()
    assert [x["row_type"] for x in r] == ["wbs", "activity", "unknown"]
    assert (r[1]["activity_name"], r[1]["start_date"], r[1]["finish_date"]) == ("Pump layout", dt.date(2007, 5, 1), dt.date(2007, 6, 1))


def test_rule_and_activity_files(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("﻿Priority;Item;MDL Document Keyword;Activity Keyword;Pur.;Validation Time\n1;HRSG;LAYOUT;P.O|FOB;For Approval;start+4W<=FA<=start+6W\n2;;LIST;;;start+1W<=FA<=start+2W\n3;;NOTE;;;-\nx;;BAD;;;-\n4;;;;;-\n", encoding="utf-8")
    rows = S.rules(spark, str(tmp_path / "rules.csv")).orderBy("rule_id").collect()
    assert [(r["priority"], r["sub_type"], r["activity_keywords"], r["vt"]["fa_lo"]) for r in rows] == [(1, "FA", ["P.O", "FOB"], 28), (2, "FA", [], 7), (3, "SKIP", [], None)]
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"row_type": "activity", "activity_id": "1", "start_date": "2007-05-01"}, {"row_type": "wbs", "activity_id": "2"}]}))
    assert [(r["activity_id"], r["start_date"]) for r in S.activities(spark, str(tmp_path / "a.json")).collect()] == [("1", dt.date(2007, 5, 1))]
    (tmp_path / "k.csv").write_bytes("이름,값\n펌프,1\n".encode("cp949"))
    assert S.read_csv(spark, str(tmp_path / "k.csv")).first()["이름"] == "펌프"


def test_graph_and_match_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, ["A"], {"k": "v"}), (2, ["B", "A"], {})], "id long, labels array<string>, props map<string,string>")
    rels = spark.createDataFrame([(1, 2, "R")], "src long, dst long, type string")
    S.export_graph(nodes, rels, str(tmp_path / "g"))
    back = S.import_graph(spark, str(tmp_path / "g"))
    assert S.graph_differences((nodes, rels), back).count() == 0 and back[0].schema == nodes.schema
    matches = spark.createDataFrame([("q", 1, "d1", "one"), ("q", 2, "d2", "two")], "query_id string, rank int, doc_id string, display string")
    S.write_matches(matches, str(tmp_path / "m"), most=3)
    r = spark.read.csv(str(tmp_path / "m" / "csv"), header=True).first()
    assert (r["Matched_Doc_1"], r["Matched_Doc_2"], r["Matched_Doc_3"], r["Matched_Doc_IDs"]) == ("one", "two", None, "d1|d2")


def test_providers(spark, tmp_path):
    class Flaky:
        """Fails for batches of more than two."""

        def judge(self, payloads):
            if len(payloads) > 2:
                raise RuntimeError("too many")
            return [p.upper() for p in payloads]

    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "id int, text string")
    assert {(r["text"], r["answer"]) for r in X.judge_rows(df, "text", Flaky()).collect()} == {(f"t{i}", f"T{i}") for i in range(5)}
    cache = str(tmp_path / "cache")
    for _ in range(2):
        out = X.embed_texts(df, "text", X.HashEmbedder(8), cache)
        assert out.count() == 20 and spark.read.parquet(cache).count() == 5
    sim = X.concept_similarity(spark.createDataFrame([("pump layout", "layout pump"), ("pump", "")], "a string, b string"), "a", "b", X.HashEmbedder(32)).orderBy("a").collect()
    assert sim[0]["concept_similarity"] is None and abs(sim[1]["concept_similarity"] - 1) < 1e-9
    assert [*X.bounded_batches(["aaa", "bb", "c" * 9, "d"], 2, 6)] == [(0, 2), (2, 3), (3, 4)]


def test_resume_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "id int, v string")
    seen = []
    work = lambda df: (seen.append(df.count()), df.withColumn("done", F.lit(True)))[1]
    out = str(tmp_path / "out")
    resume.resume(rows.filter("id < 4"), work, out, ["id"])
    assert resume.resume(rows, work, out, ["id"]).count() == 6 and seen == [4, 2]
    rows.write.parquet(str(tmp_path / "in"))
    rows.filter("id < 2").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        resume.resume_stream(stream, lambda df: df, str(tmp_path / "sink"), str(tmp_path / "ck"), ["id"]).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == list(range(6))

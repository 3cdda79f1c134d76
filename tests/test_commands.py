"""The commands from files to files."""

import json

from dossier import cli
from dossier.sources.office import workbook_bytes


def test_schedule_command(spark, tmp_path):
    (tmp_path / "docs.csv").write_text("Title,Equipment,System,Building,Deliverable\nHRSG General Arrangement Drawing,HRSG,,,GA\nQuay wall photographs,,,,\n", encoding="utf-8-sig")
    (tmp_path / "rules.csv").write_text("Priority;Item;MDL Document Keyword;Activity Keyword;Pur.;Validation Time\n1;;General Arrangement Drawing for HRSG;P.O;FA;start+4W<=FA<=start+6W\n", encoding="utf-8")
    rows = [{"row_type": "activity", "activity_id": "A1", "activity_name": "HRSG P&ID system design", "wbs_path": "HRSG", "start_date": "2024-01-01", "finish_date": "2024-03-01"}, {"row_type": "wbs", "activity_id": "W"}]
    (tmp_path / "activities.json").write_text(json.dumps({"rows": rows}))
    assert cli.main(["schedule", *(str(tmp_path / n) for n in ("docs.csv", "rules.csv", "activities.json", "out"))]) == 0
    found = {r["title"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert str(found["HRSG General Arrangement Drawing"]["fa_earliest"]) == "2024-01-29" and found["HRSG General Arrangement Drawing"]["date_status"] == "generated"
    assert found["Quay wall photographs"]["date_status"] == "no_rule"


def test_titles_and_tables(spark, tmp_path, capsys):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(workbook_bytes({"s": [["Doc No", "Title"], ["D1", "Pump List"], ["D2", "pump  list"]], "t": [["Title"], ["Layout"]]}))
    assert cli.main(["titles", str(folder), str(tmp_path / "titles")]) == 0
    assert {r["title"]: r["document_no"] for r in spark.read.parquet(str(tmp_path / "titles")).collect()} == {"Pump List": "D1 | D2", "Layout": ""}
    assert cli.main(["empty", str(tmp_path / "titles")]) == 0 and capsys.readouterr().out.strip().endswith("2")
    assert cli.main(["query", "never", "x", "y"]) == 2


def test_chunks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one two three four five\n\nsix")
    assert cli.main(["chunk", str(tmp_path / "t.txt"), str(tmp_path / "out"), "--most", "3"]) == 0
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_index").collect()] == ["one two three", "four five\nsix"]


def test_register_and_ingest(spark, tmp_path, capsys):
    (tmp_path / "r.csv").write_text("Title,Equipment,System,Building,Deliverable,No\nPROCESS FLOW DIAGRAM FOR CCW SYSTEM,,,,,7\nSITE PLAN,,,,PLAN,8\n")
    assert cli.main(["clean-register", str(tmp_path / "r.csv"), str(tmp_path / "clean")]) == 0
    assert "scope_status:plant_general 1" in capsys.readouterr().out
    assert {r["No"]: r["system"] for r in spark.read.parquet(str(tmp_path / "clean")).collect()} == {"7": "Closed Cooling Water System", "8": "Plant General System"}
    for number, titles in ((1, ["Pump List", "Layout"]), (2, ["layout", "Valve List"])):
        folder = tmp_path / f"b{number}"
        folder.mkdir()
        (folder / "a.xlsx").write_bytes(workbook_bytes({"s": [["Doc No", "Title"], *[[f"D{number}{i}", t] for i, t in enumerate(titles)]]}))
        assert cli.main(["ingest", str(folder), str(tmp_path / "catalog"), str(number)]) == 0
    assert capsys.readouterr().out.split() == ["2", "3"]


def test_match_and_rerank(spark, tmp_path):
    (tmp_path / "q.csv").write_text("chunk_id,query,is_candidate\nc1,steam turbine data sheet,yes\nc2,anything,no\n")
    (tmp_path / "c.csv").write_text("doc_id,title,text\nD1,Steam turbine,data sheet of the turbine\nD2,Layout,general layout\nD3,Gas turbine,data\n")
    assert cli.main(["match", str(tmp_path / "q.csv"), str(tmp_path / "c.csv"), str(tmp_path / "run"), "--shown", "2"]) == 0
    assert {r["chunk_id"]: r["Matched_Doc_1"] for r in spark.read.parquet(str(tmp_path / "run")).collect()} == {"c1": "D1 | Steam turbine", "c2": ""}
    assert cli.main(["rerank", str(tmp_path / "run"), str(tmp_path / "again"), "--shown", "1"]) == 0
    found = {r["chunk_id"]: r for r in spark.read.parquet(str(tmp_path / "again")).collect()}
    assert found["c1"]["Matched_Doc_1"] == "D1 | Steam turbine" and "Matched_Doc_2" not in found["c1"].asDict()


def test_structure(spark, tmp_path):
    (tmp_path / "p.html").write_text("<h1>One</h1><p>a b<p>c<h2>Two</h2><p>d")
    assert cli.main(["structure", str(tmp_path / "p.html"), str(tmp_path / "out")]) == 0
    assert [(r["text"], r["headings"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_index").collect()] == [("a b\nc", ["One"]), ("d", ["One", "Two"])]

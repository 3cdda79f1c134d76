"""The schedule chain on every part: each stands for a document whose outcome is worked out by hand."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import parse_validation_time
from dossier.operators import schedule as S
from dossier.operators.providers import HashEmbedder, OverlapScorer
from dossier.plans.cases import case_rows
from dossier.plans.registry import Tables, query

#: title, equipment, system, building, deliverable, candidate_status, match_score of each case.
DOCS = (
    ("HRSG General Arrangement Drawing", "HRSG", None, None, "GA", "accepted", "0.9"),
    ("Gas turbine data sheet", "Gas Turbine Generator", None, None, "Data Sheet", "", None),
    ("Quay wall photographs", None, None, None, None, "accepted", None),
    ("As built layout of ACC", "ACC", None, None, "Layout", "accepted", None),
    ("Operation manual of ACC", None, None, None, "Manual", "accepted", "0.79"),
    ("ACC instrument list", "ACC", None, None, "Instrument List", "accepted", None),
    ("Welding procedure for tanks", None, None, None, "Procedure", "needs_review", None),
)
RULES = (
    (1, 1, "", "General Arrangement Drawing for HRSG", ["P.O"], "FA", "start+4W<=FA<=start+6W"),
    (2, 1, "", "GTG Data Sheet", ["P.O"], "FA", "start+2W<=FA<=start+4W"),
    (3, 2, "", "ACC Layout Drawing", [], "SKIP", "-"),
    (4, 1, "", "General Arrangement Drawing for GTG", ["P.O"], "FA", "start+1W<=FA<=start+2W"),
    (5, 1, "", "Operation Manual", ["Delivery"], "FA", "start+1W<=FA<=start+2W"),
    (6, 1, "", "Instrument List", ["Erection"], "FA", "start+2W<=FA<=start+3W"),
    (7, 3, "", "Instrument List for ACC", ["P.O"], "FA", "start+8W<=FA<=start+9W"),
    (8, 1, "", "Welding Procedure", [], "FA", "start+3W<=FA<=start+5W"),
)
ACTIVITIES = (
    (11, "HRSG P&ID system design", "HRSG", dt.date(2024, 1, 1), dt.date(2024, 3, 1)),
    (12, "HRSG P.O", "HRSG", dt.date(2024, 2, 1), dt.date(2024, 2, 10)),
    (13, "GTG P.O vendor data", "Gas Turbine", dt.date(2024, 5, 6), dt.date(2024, 6, 1)),
    (14, "ACC erection", "ACC", dt.date(2025, 1, 1), dt.date(2025, 3, 1)),
    *((20 + k, f"Operation manual of lot {k} delivery", "Site", dt.date(2025, 6, k), dt.date(2025, 7, k)) for k in range(1, 9)),
)


class CaseJudge:
    """Takes the specific rule for an air cooled condenser, the generic one elsewhere."""

    def judge(self, payloads: Sequence[str]) -> list[str]:
        return ["use_specific" if '"equipment":"ACC"' in p else "generic_ok" for p in payloads]


def schedule(t: Tables, mode: str) -> DataFrame:
    docs = case_rows(t, "title equipment system building deliverable candidate_status match_score", DOCS).withColumnRenamed("p_partkey", "doc_id")
    rules = t.spark.createDataFrame([*RULES], "rule_id int, priority int, item string, doc_keyword string, activity_keywords array<string>, sub_type string, formula string").withColumn("vt", parse_validation_time("formula"))
    activities = t.spark.createDataFrame([*ACTIVITIES], "activity_id long, activity_name string, wbs_path string, start_date date, finish_date date")
    mapping = t.spark.createDataFrame([("manual", "acc", ["installation"]), ("manual", "*", ["delivery"])], S.MAPPING)
    found = S.generate_schedule(docs.drop("case_id"), rules, activities, OverlapScorer(), HashEmbedder(64), CaseJudge(), mapping, mode)
    return found.withColumn("case_id", (F.col("doc_id") % len(DOCS)).cast("int"))


_COLUMNS = "case_id, rule_id, query_source, verdict, activity_id, resolution, date_status, fa_earliest, fa_latest, status"


def _expected(values: str) -> str:
    return f"SELECT p_partkey, {_COLUMNS} FROM (SELECT p_partkey, CAST(p_partkey % {len(DOCS)} AS INTEGER) AS case_id FROM part) JOIN (VALUES {values}) v({_COLUMNS}) USING (case_id)"


def _shown(found: DataFrame) -> DataFrame:
    verdict = F.coalesce("generic_verdict", "generic_bucket")
    return found.select(F.col("doc_id").alias("p_partkey"), "case_id", "rule_id", "query_source", verdict.alias("verdict"), "activity_id", "resolution", "date_status", "fa_earliest", "fa_latest", "schedule_quality.status")


@query(_expected("""(0, 1, 'primary', NULL, 11, 'structured_cell_found_text_preferred', 'generated', DATE '2024-01-29', DATE '2024-02-12', 'usable'),
(1, 2, 'primary', NULL, 13, 'structured_cell_found_text_preferred', 'generated', DATE '2024-05-20', DATE '2024-06-03', 'usable'), (2, NULL, 'primary', NULL, 11, 'structured_no_system', 'no_rule', NULL, NULL, 'blocked_no_rule'),
(3, 3, 'primary', NULL, 11, 'structured_phase_gap', 'skip', NULL, NULL, 'skip'), (4, 5, 'title', 'safe', 14, 'structured_preferred', 'generated', DATE '2025-03-08', DATE '2025-03-15', 'usable'),
(5, 6, 'primary', 'use_specific', 14, 'structured_no_phase', 'generated', DATE '2025-01-15', DATE '2025-01-22', 'needs_review'), (6, 8, 'title', 'safe', 11, 'structured_no_system', 'generated', DATE '2024-01-22', DATE '2024-02-05', 'needs_review_candidate')"""))
def schedule_end_to_end(t: Tables) -> DataFrame:
    """Rules of other systems are kept out, weak ones are looked up by title, a judge settles generic ones; a manual meets the activity of its own cell."""
    return _shown(schedule(t, "hybrid"))


@query(_expected("""(0, 1, 'primary', NULL, 11, 'structured_cell_found_text_preferred', 'blocked_activity', NULL, NULL, 'blocked_activity'),
(1, 2, 'primary', NULL, 13, 'structured_cell_found_text_preferred', 'blocked_activity', NULL, NULL, 'blocked_activity'), (2, NULL, 'primary', NULL, 11, 'structured_no_system', 'no_rule', NULL, NULL, 'blocked_no_rule'),
(3, 3, 'primary', NULL, 11, 'structured_phase_gap', 'skip', NULL, NULL, 'skip'), (4, 5, 'title', 'safe', 14, 'structured_preferred', 'generated', DATE '2025-03-08', DATE '2025-03-15', 'usable'),
(5, 6, 'primary', 'use_specific', 14, 'structured_no_phase', 'blocked_activity', NULL, NULL, 'blocked_activity'), (6, 8, 'title', 'safe', 11, 'structured_no_system', 'blocked_activity', NULL, NULL, 'blocked_activity')"""))
def schedule_by_cells(t: Tables) -> DataFrame:
    """Structured mode: a row whose cell doesn't lead shows its activity by text and is held back."""
    return _shown(schedule(t, "structured"))

"""Match quality, requirement and match records, payloads, templates, run loading and files written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import evaluation as E
from dossier.operators import filters as P
from dossier.operators import listing as L
from dossier.operators import matching as M
from dossier.operators import providers as X
from dossier.operators import records as Q
from dossier.operators import registers as G
from dossier.plans.registry import Tables, query
from dossier.sources import files as S
from dossier.sources.scratch import scratch_folder


def _pick(x: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(x, F.lit(len(values))) + 1).cast("int"))


def _keys(x: Column, *values: str) -> Column:
    v = _pick(x, *values)
    return F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(v, "\\|"))


@query("""WITH x AS (SELECT p_partkey, ['procurement', 'delivery', '', 'manual'][1 + p_partkey % 4] AS qp, ['', 'hrsg', 'bop'][1 + p_partkey % 3] AS qs, ['acc', ''][1 + p_partkey % 2] AS rs,
['HRSG P.O', 'ACC delivery', 'Design Criteria'][1 + p_size % 3] AS act, p_size % 5 AS rank, round(p_retailprice / 1000, 4) AS s FROM part),
y AS (SELECT *, CASE act WHEN 'HRSG P.O' THEN 'procurement' WHEN 'ACC delivery' THEN 'delivery' ELSE 'design_criteria' END AS ap, CASE act WHEN 'HRSG P.O' THEN 'hrsg' WHEN 'ACC delivery' THEN 'acc' ELSE '' END AS asc_, CASE WHEN qs <> '' THEN qs ELSE rs END AS es FROM x)
SELECT p_partkey, ap AS activity_match_activity_phase, CASE WHEN qp = '' THEN 'query_unknown' WHEN qp = ap THEN 'match' WHEN qp = 'manual' AND ap IN ('delivery', 'procurement', 'installation') THEN 'compatible' ELSE 'mismatch' END AS activity_match_phase_status,
es AS activity_match_effective_scope, CASE WHEN qs <> '' THEN 'query' WHEN rs <> '' THEN 'rule' ELSE '' END AS activity_match_scope_source, asc_ AS activity_match_activity_scope,
CASE WHEN es = '' THEN 'query_unscoped' WHEN asc_ = '' THEN 'activity_unscoped' WHEN es = asc_ THEN 'match' ELSE 'mismatch' END AS activity_match_scope_status,
CASE WHEN act = 'Design Criteria' THEN 'true' ELSE 'false' END AS activity_match_generic_activity, CASE WHEN rank > 0 THEN rank::VARCHAR ELSE '' END AS activity_match_bm25_rank, printf('%.4f', s) AS activity_match_rrf_score FROM y""")
def activity_quality(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        "p_partkey", _pick(k, "procurement", "delivery", "", "manual").alias("query_phase"), _keys(k, "", "hrsg", "bop").alias("query_scopes"), _keys(k, "acc", "").alias("rule_scopes"), F.lit("").alias("rule_phase"),
        _pick(s, "HRSG P.O", "ACC delivery", "Design Criteria").alias("activity_name"), F.lit("").alias("activity_name_clean"), F.lit(None).cast("string").alias("wbs_path"), F.lit(True).alias("agreement"),
        (s % 5).alias("bm25_rank"), F.lit(None).cast("int").alias("semantic_rank"), *[F.round(F.col("p_retailprice") / 1000, 4).alias(c) for c in ("bm25_score", "semantic_score", "rrf_score", "adjusted_score")],
    )
    wanted = ("activity_phase", "phase_status", "effective_scope", "scope_source", "activity_scope", "scope_status", "generic_activity", "bm25_rank", "rrf_score")
    return Q.with_activity_quality(rows).select("p_partkey", *[f"activity_match_{c}" for c in wanted])


@query("""WITH x AS (SELECT p_partkey, p_partkey % 5 <> 0 AS hit, ['drawing', 'diagram', 'specification'][1 + p_partkey % 3] AS qf, ['drawing', 'datasheet'][1 + p_size % 2] AS rf, ['', 'acc'][1 + p_size % 2] AS qs, ['', 'acc', 'gtg'][1 + p_partkey % 3] AS rs,
['layout', 'pump - data', 'LAYOUT FOR ROADS'][1 + p_size % 3] AS kw, ['', 'scope_mismatch'][1 + p_size % 2] AS g FROM part)
SELECT p_partkey, CASE WHEN NOT hit THEN '' WHEN rs <> '' THEN 'scoped' WHEN kw = 'layout' THEN 'generic' ELSE 'implicit_specific' END AS rule_match_rule_scope_type,
CASE WHEN NOT hit THEN '' WHEN qf = rf THEN 'match' WHEN (qf, rf) IN (('specification', 'datasheet')) THEN 'compatible' WHEN (qf, rf) IN (('diagram', 'drawing')) THEN 'mismatch' ELSE 'mismatch' END AS rule_match_family_status,
CASE WHEN NOT hit THEN CASE WHEN qs = '' THEN 'query_unscoped' ELSE 'no_rule' END WHEN qs = '' THEN 'query_unscoped' WHEN rs = '' THEN 'rule_generic' WHEN qs = rs THEN 'match' ELSE 'mismatch' END AS rule_match_scope_status,
CASE WHEN NOT hit THEN 'no_match' WHEN g = '' THEN 'passed' ELSE 'rejected' END AS rule_match_guard_status, CASE WHEN hit THEN g ELSE '' END AS rule_match_guard_reason, CASE WHEN hit THEN '0.2500' ELSE '' END AS rule_match_final_score FROM x""")
def rule_quality(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        "p_partkey", F.when(k % 5 != 0, k).alias("rule_id"), F.lit("primary").alias("query_source"), _pick(k, "drawing", "diagram", "specification").alias("query_family"), F.lit("").alias("query_subtype"), _keys(s, "", "acc").alias("query_scopes"),
        _pick(s, "drawing", "datasheet").alias("rule_family"), F.lit("").alias("rule_subtype"), _keys(k, "", "acc", "gtg").alias("rule_scopes"), _pick(s, "layout", "pump - data", "LAYOUT FOR ROADS").alias("rule_keyword"), _pick(s, "", "scope_mismatch").alias("guard"),
        *[F.lit(0.25).alias(c) for c in ("token_score", "semantic_score", "hybrid_score", "final_score")],
    )
    return Q.with_rule_quality(rows).select("p_partkey", *[f"rule_match_{c}" for c in ("rule_scope_type", "family_status", "scope_status", "guard_status", "guard_reason", "final_score")])


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A' AND l_linestatus <> 'F') OR ((l_returnflag = 'A') = (l_linestatus = 'F') AND l_partkey < l_suppkey) AS replaced FROM lineitem")
def rule_tie_break(t: Tables) -> DataFrame:
    replaced = Q.tie_break(F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", F.col("l_partkey"), F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", replaced.alias("replaced"))


@query("""SELECT o_orderkey, 'doc' AS document, 'c' || o_orderkey AS chunk_id, o_custkey % 7 || ', ' || o_custkey % 5 AS pages, trim(o_orderpriority) AS depth_1, o_orderstatus AS depth_2, '' AS depth_3, 'a, b' AS keywords,
CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'no' ELSE 'True' END AS is_candidate FROM orders""")
def requirement_rows(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    rows = t.orders.select(
        "o_orderkey", F.lit("doc").alias("document"), F.concat(F.lit(" c"), "o_orderkey").alias("chunk_id"), F.array(k % 7, k % 5).alias("page_num"), F.lit("3").alias("section"), F.lit("H").alias("hierarchy"),
        F.array("o_orderpriority", "o_orderstatus").alias("depths"), F.array(F.lit("a"), F.lit(" "), F.lit("b ")).alias("keywords"), F.when(F.col("o_orderstatus") == "O", " no").when(F.col("o_orderstatus") == "F", "").alias("candidate"), F.lit(None).cast("string").alias("skip_reason"), F.lit("t").alias("text"),
    )
    out = Q.requirement_records(rows, 3)
    return out.withColumn("o_orderkey", F.substring("chunk_id", 2, 20).cast("long")).select("o_orderkey", "document", "chunk_id", "pages", "depth_1", "depth_2", "depth_3", "keywords", "is_candidate")


@query("SELECT 'c' || o_orderkey AS chunk_id, '5' AS requested_section, o_orderpriority AS actual_section, '' AS reason FROM orders WHERE o_orderstatus = 'F'")
def rejected_requirements(t: Tables) -> DataFrame:
    rows = t.orders.select(F.lit("doc").alias("document"), F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "").alias("belongs"), F.col("o_orderpriority").alias("actual_section"), F.lit(None).cast("string").alias("boundary_reason"))
    return Q.rejected_records(rows, "5").drop("document")


@query("""WITH m AS (SELECT l_orderkey AS key, l_linenumber AS rank, 'd' || l_partkey AS display FROM lineitem WHERE l_orderkey % 3 <> 0),
w AS (SELECT key, count(*) AS n, max(CASE WHEN rank = 1 THEN display END) AS a, max(CASE WHEN rank = 2 THEN display END) AS b FROM m GROUP BY 1)
SELECT o_orderkey, o_orderstatus || ' | ' || o_orderpriority AS "Requirement_Intent_Equipment", coalesce(n, 0) AS n_candidates, coalesce(a, '') AS "Matched_Doc_1", coalesce(b, '') AS "Matched_Doc_2" FROM orders LEFT JOIN w ON key = o_orderkey""")
def match_rows(t: Tables) -> DataFrame:
    asked = t.orders.select("o_orderkey", F.array("o_orderstatus", F.lit(" "), "o_orderpriority").alias("equipment"))
    found = t.lineitem.filter("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("d"), "l_partkey").alias("display"))
    return Q.match_rows(asked, found, "o_orderkey", 2)


@query("""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))[1:1200] AS title, lang FROM documents""")
def model_payloads(t: Tables) -> DataFrame:
    made = Q.model_payload(t.documents, "doc_id", ["text", "lang"], None, "text")
    return made.select("doc_id", F.get_json_object("payload", "$.text").alias("title"), F.get_json_object("payload", "$.lang").alias("lang"))


@query("SELECT 'Prompt Rejection' AS kind, 'review' AS severity, '' AS scope, p_name AS standardized_document_title, p_brand AS reason FROM part WHERE p_size < 10")
def rejections_as_validation(t: Tables) -> DataFrame:
    rejected = t.part.filter("p_size < 10").select(F.concat(F.lit(" "), "p_name").alias("source_title"), F.col("p_brand").alias("reason"))
    columns = ["validation_type", "severity", "scope", "standardized_document_title", "reason"]
    return Q.rejections_as_validation(rejected, columns, "Prompt Rejection", "Review.").withColumnRenamed("validation_type", "kind")


@query("""SELECT p_brand AS canonical, v AS variant FROM (SELECT DISTINCT p_brand, unnest([p_brand, lower(p_brand)]) AS v FROM part)""")
def abbreviation_variants(t: Tables) -> DataFrame:
    return Q.variants(t.part.select(F.col("p_brand").alias("canonical"), F.array(F.lower("p_brand"), "p_brand").alias("variants")).distinct()).select("canonical", "variant")


@query(r"""SELECT conv_id, turn, 'A > turn ' || turn AS hierarchy, list_sort(list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') THEN 'the' END], lambda x: x IS NOT NULL)) AS known FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def prepared_chunks(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.lit("doc").alias("document"), F.lit("c").alias("chunk_id"), F.array(F.lit(1)).alias("page_num"), F.concat(F.lit("doc > A > temp > turn "), "turn").alias("hierarchy_context"), "text")
    return Q.prepared_chunks(rows, [("the", "THE ARTICLE"), ("And", "and")], ("temp",)).select("conv_id", "turn", "hierarchy", F.array_sort(F.map_keys("known")).alias("known"))


@query("""SELECT g.doc_id, c.chunk_id, coalesce(t.section, '') AS section, g.status AS expected_date_status, '' AS expected_activity_id FROM (SELECT o_orderkey AS doc_id, o_orderstatus AS status, unnest(['a', 'b']) AS chunk_id FROM orders WHERE o_orderkey % 2 = 0) g,
LATERAL (SELECT g.chunk_id) c LEFT JOIN (SELECT o_orderkey AS doc_id, 'a' AS chunk_id, o_orderpriority AS section FROM orders WHERE o_orderkey % 4 = 0) t ON t.doc_id = g.doc_id AND t.chunk_id = c.chunk_id""")
def gold_template(t: Tables) -> DataFrame:
    made = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("t").alias("title"), (F.col("o_orderkey") % 2 == 0).alias("exact_hit"), F.lit(" a;;b ").alias("positive_chunks"), F.lit("k").alias("rule_keyword"), F.lit("FA").alias("submission_type"), F.col("o_orderstatus").alias("date_status"))
    truth = t.orders.filter("o_orderkey % 4 = 0").select(F.lit("a").alias("chunk_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("section"))
    return Q.gold_template(made, truth).select("doc_id", "chunk_id", "section", "expected_date_status", "expected_activity_id")


@query("""WITH r AS (SELECT o_custkey % 3 = 0 AS inside, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '' END AS said FROM orders)
SELECT CASE WHEN inside THEN 'good' ELSE 'non_good' END AS slice, count(*) AS n, count(*) FILTER (said = 'yes') AS said_yes, round(count(*) FILTER (said = 'yes') / count(*) FILTER (said <> ''), 6) AS said_accuracy FROM r GROUP BY 1""")
def sliced_scores(t: Tables) -> DataFrame:
    review = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no").alias("said"))
    generated = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3 == 0).alias("good"))
    return Q.sliced_scores(review, generated, ["o_custkey"], "good", ["said"])


@query("SELECT o_orderpriority || ' rows' AS field, count(*) AS value FROM orders GROUP BY 1 UNION ALL SELECT 'Clean row count', count(*) FROM orders")
def schedule_metadata(t: Tables) -> DataFrame:
    return Q.schedule_metadata(t.orders, "o_orderpriority")


_RUNS = "r AS (SELECT '3' AS section, o_orderkey, o_custkey, o_orderkey % 2 = 0 AS kept FROM orders WHERE o_orderkey % 7 <> 0)"


def _runs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.lit("3").alias("section"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" "), k.cast("string"))).alias("chunk_id"), F.concat_ws("|", F.lit("a"), F.lit(" "), "o_custkey", F.lit("a")).alias("matched_ids"), F.when(k % 2 == 0, "x|y|z").alias("retrieval_ids"))


@query(f"""WITH {_RUNS} SELECT '3:' || o_orderkey AS query_id, 'matched' AS list, unnest([1, 2]) AS rank, unnest(['a', o_custkey::VARCHAR]) AS doc_id FROM r
UNION ALL SELECT '3:' || o_orderkey, 'retrieved', unnest([1, 2, 3]), unnest(['x', 'y', 'z']) FROM r WHERE kept""")
def run_rankings(t: Tables) -> DataFrame:
    return Q.run_rankings(_runs(t))[0]


@query(f"WITH {_RUNS} SELECT 2 AS output_limit, 3 AS retrieval_limit, bool_and(kept) AS complete FROM r")
def run_limits(t: Tables) -> DataFrame:
    return Q.run_rankings(_runs(t))[1]


@query("SELECT o_orderkey, o_orderstatus AS hybrid_status, round(o_totalprice, 2) AS hybrid_score, '' AS hybrid_note FROM orders")
def run_of_mode(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus").alias("status"), F.round("o_totalprice", 2).cast("string").alias("score"))
    return Q.run_of_mode(rows, "hybrid", ["o_orderkey"], {"status": "status", "score": "score", "note": "note"}, ["score"])


@query("SELECT p_size::VARCHAR AS section FROM part WHERE p_partkey % 3 < 2 GROUP BY 1 HAVING count(DISTINCT p_partkey % 3) = 2")
def shared_artifact_sections(t: Tables) -> DataFrame:
    """Artifacts of two modes, named by part sizes; a third of the names is of another kind."""
    mode, kind = F.when(F.col("p_partkey") % 3 == 0, "keyword").otherwise("hybrid"), F.when(F.col("p_partkey") % 3 == 2, ".json").otherwise(".csv")
    return S.sections_of_modes(t.part.select(mode.alias("mode"), F.concat(F.lit("out_section"), F.col("p_size").cast("string"), kind).alias("name")), "out_section")


# Operators that had no query: each is called itself.


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'promo') OR contains(lower(p_name), 'promo') OR contains(lower(p_type), 'ring')")
def export_catalog(t: Tables) -> DataFrame:
    return S.export_catalog(t.part, ["Ring", "PROMO"], ["p_name", "p_type"], ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small') ORDER BY p_partkey LIMIT 25")
def export_catalog_limit(t: Tables) -> DataFrame:
    return S.export_catalog(t.part, ["small"], ["p_name"], ["p_partkey"], 25).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def retrieval_candidates(t: Tables) -> DataFrame:
    flag = F.when(F.col("c_mktsegment") == "BUILDING", "No").when(F.col("c_mktsegment") == "MACHINERY", " false ").when(F.col("c_mktsegment") == "FURNITURE", "").otherwise("TRUE")
    return P.retrieval_candidates(t.customer.withColumn("flag", flag), "flag").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def allowed_values(t: Tables) -> DataFrame:
    return P.allowed_values(t.customer.withColumn("c_mktsegment", F.concat(F.lit(" "), F.initcap("c_mktsegment"))), "c_mktsegment", ["Building", "machinery"]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def schedulable(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "Accepted").when(F.col("o_orderpriority") == "2-HIGH", "needs_review").otherwise("rejected")
    return P.schedulable(t.orders.withColumns({"candidate_selection_status": F.when(F.col("o_orderstatus") == "F", "Selected").otherwise("out"), "candidate_status": status})).select("o_orderkey")


@query("SELECT p_partkey, 'Gas Turbine Generator' AS canonical_equipment, upper(p_brand) AS canonical_system, 'drawing' AS canonical_family, 'layout_drawing' AS canonical_subtype, 'Gas Turbine Generator ' || upper(p_brand) AS canonical_scope_text FROM part")
def canonical_columns(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "GT").otherwise(" ").alias("equipment"), F.lit("GTG hall").alias("title"), F.concat(F.lit(" "), F.lower("p_brand")).alias("system"), F.lit(None).cast("string").alias("building"), F.lit("Layout").alias("deliverable"))
    return G.canonical_columns(rows).select("p_partkey", "canonical_equipment", "canonical_system", "canonical_family", "canonical_subtype", "canonical_scope_text")


@query("""SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(upper(p_name || ' of a1 ' || p_type), '[A-Z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('SMALL', 'OF')))) AS tokens FROM part""")
def review_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_sort(T.review_tokens(F.concat_ws(" of a1 ", "p_name", "p_type"), ("SMALL", "OF"))).alias("tokens"))


@query("SELECT n_name, list_sort([n_name, r_name]) AS places FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> ''")
def known_pairs(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = T.keep_known(F.create_map(F.lit("a"), "n_name", F.lit("b"), F.col("r_name"), F.lit("c"), F.lit(""), F.lit("d"), F.lit(None).cast("string")))
    return rows.select("n_name", F.array_sort(F.map_values(pairs)).alias("places"))


@query("SELECT n_nationkey, [n_name, CASE WHEN n_name = 'CHINA' THEN 'PEOPLES REPUBLIC' END] AS names FROM nation WHERE n_name = 'CHINA' UNION ALL SELECT n_nationkey, [n_name] FROM nation WHERE n_name <> 'CHINA'")
def expanded_names(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", T.with_expansions(F.array("n_name"), [("China", "PEOPLES REPUBLIC")]).alias("names"))


@query("SELECT p_partkey, 'cut: ' || p_name AS answer, '' AS failed FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'kept', '' FROM part WHERE p_size % 2 = 1")
def retried_rows(t: Tables) -> DataFrame:
    class Echo:
        version = "echo"

        def judge(self, texts: list[str]) -> list[str]:
            return ["cut: " + x for x in texts]

    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, "timeout").otherwise("").alias("failed"), F.lit("kept").alias("answer"))
    return X.retry_failed(rows, "failed", "p_name", Echo()).select("p_partkey", "answer", "failed")


# Files written and read again.


@query("SELECT p_partkey, nullif(trim(p_name), '') AS p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS note FROM part")
def csv_round_trip(t: Tables) -> DataFrame:
    """With a byte order mark, quotes, line breaks, blanks and `nan`."""
    folder = scratch_folder(t.spark)
    rows = t.part.select("p_partkey", F.concat(F.lit(" "), "p_name").alias("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("nan").alias("note"))
    S.write_csv_with_mark(rows, folder, ["p_partkey", "p_name", "note"])
    return S.read_csv(t.spark, folder).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT n_nationkey, n_name, 'é' AS mark FROM nation UNION ALL SELECT 1000 + n_nationkey, '한국 ' || n_name, '도면' FROM nation")
def csv_of_two_charsets(t: Tables) -> DataFrame:
    """A file in another charset is decoded by itself; the UTF-8 files beside it stay as they are."""
    folder = scratch_folder(t.spark)
    plain = t.nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.lit("é").alias("mark"))
    plain.coalesce(1).write.csv(f"{folder}/a", header=True)
    lines = t.nation.select(F.concat_ws(",", (F.col("n_nationkey") + 1000).cast("string"), F.concat(F.lit("한국 "), "n_name"), F.lit("도면")).alias("value"))
    whole = lines.agg(F.concat(F.lit("n_nationkey,n_name,mark\n"), F.array_join(F.collect_list("value"), "\n")).alias("value")).first()["value"]
    # 25 lines of a fixed table, written as bytes of the other charset through the same store
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/b/part.csv")
    out = path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(whole.encode(S.FALLBACK_ENCODING)))
    out.close()
    return S.read_csv(t.spark, f"{folder}/*").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))


#: Priority, item, keyword, activity keywords, code and formula of each kind of rule row.
_RULE_ROWS = (("1", "Item", "acc layout", "P.O| FOB ", "", "start+4W<=FA<=start+6W"), ("2", "", "pump data", "", "", "-"), ("x", "", "never", "", "FA", ""), ("1", "", "plan", "Test", "For Construction", "start-3M<=FC<=start-1M"), ("2", "", "", "", "FA", ""), ("3", "", "odd", "", "else", ""))


@query("""SELECT priority, doc_keyword || ' ' || p_partkey AS doc_keyword, activity_keywords, sub_type, parses FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)
JOIN (VALUES (0, 1, 'acc layout', ['P.O', 'FOB'], 'FA', true), (1, 2, 'pump data', [], 'SKIP', false), (3, 1, 'plan', ['Test'], 'FC', true), (5, 3, 'odd', [], 'UNKNOWN', false)) v(k, priority, doc_keyword, activity_keywords, sub_type, parses) USING (k)""")
def rule_file(t: Tables) -> DataFrame:
    """A rule row for each part; rows without a numeric priority or a keyword are left out, a blank code follows from the formula."""
    folder, at = scratch_folder(t.spark), (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in _RULE_ROWS]), at)
    keyword = F.when(pick(2) != "", F.concat(pick(2), F.lit(" "), F.col("p_partkey").cast("string"))).otherwise("")
    names = ("Priority", "Item", "MDL Document Keyword", "Activity Keyword", "Pur.", "Validation Time")
    t.part.select(*[(keyword if i == 2 else pick(i)).alias(n) for i, n in enumerate(names)]).write.csv(folder, header=True, sep=";")
    return S.rules(t.spark, folder).select("priority", "doc_keyword", "activity_keywords", "sub_type", F.col("vt.valid").alias("parses"))


@query("SELECT o_orderkey, o_orderdate::DATE AS start_date FROM orders WHERE o_orderstatus = 'F'")
def activity_file(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark)
    row = F.struct(F.when(F.col("o_orderstatus") == "F", "activity").otherwise("wbs").alias("row_type"), F.col("o_orderkey").cast("string").alias("activity_id"), F.lit("n").alias("activity_name"), F.col("o_orderdate").cast("string").alias("start_date"), F.lit("soon").alias("finish_date"))
    t.orders.groupBy((F.col("o_orderkey") % 16).alias("part")).agg(F.collect_list(row).alias("rows")).write.partitionBy("part").json(folder)
    return S.activities(t.spark, folder).filter("finish_date is null").select(F.col("activity_id").cast("long").alias("o_orderkey"), "start_date")


@query("""SELECT lower(p_name) AS family, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE '*' END AS scope, CASE p_partkey % 4 WHEN 0 THEN ['design', 'po'] WHEN 1 THEN ['po'] ELSE [] END AS phases FROM part""")
def mapping_file(t: Tables) -> DataFrame:
    """A mapping row for each part, names in any case with blanks around, scopes and phases partly missing."""
    folder, k = scratch_folder(t.spark), F.col("p_partkey")
    scope = F.when(k % 3 == 0, F.upper("p_brand")).when(k % 3 == 1, "").otherwise("nan")
    phases = F.when(k % 4 == 0, "Design | PO").when(k % 4 == 1, "po").otherwise("")
    t.part.select(F.concat(F.lit(" "), "p_name").alias("deliverable_family"), scope.alias("scope_family"), phases.alias("allowed_activity_phases")).write.csv(folder, header=True)
    return S.domain_mapping(t.spark, folder)


@query("""WITH m AS (SELECT l_orderkey, l_linenumber AS rank, 'd' || l_partkey AS display FROM lineitem WHERE l_linenumber <= 3) SELECT l_orderkey, max(CASE WHEN rank = 1 THEN display END) AS "Matched_Doc_1", max(CASE WHEN rank = 2 THEN display END) AS "Matched_Doc_2", string_agg(CASE WHEN rank <= 2 THEN rank || 'k' END, '|' ORDER BY rank) AS ids FROM m GROUP BY 1 HAVING min(rank) <= 2""")
def written_matches(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark)
    found = t.lineitem.filter("l_linenumber <= 3").select(F.col("l_orderkey"), F.col("l_linenumber").alias("rank"), F.concat(F.col("l_linenumber").cast("string"), F.lit("k")).alias("doc_id"), F.concat(F.lit("d"), "l_partkey").alias("display"))
    S.write_matches(found, folder, "l_orderkey", 2)
    return t.spark.read.csv(f"{folder}/csv", header=True).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "Matched_Doc_1", "Matched_Doc_2", F.col("Matched_Doc_IDs").alias("ids"))


@query("SELECT o_orderkey AS document_id, 'x/' || o_orderkey AS source_path, 512 AS max_tokens, count(*) AS chunk_count, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def chunk_documents(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("text"))
    return S.chunk_documents(rows, "x/", 512).select("document_id", "source_path", "max_tokens", F.col("chunk_count").cast("long").alias("chunk_count"), F.transform("chunks", lambda c: c["text"]).alias("parts"))


@query("SELECT 'replaced' AS step, (SELECT count(*) FROM nation) AS before, (SELECT count(*) FROM region) AS now UNION ALL SELECT 'emptied', (SELECT count(*) FROM region), 0")
def replaced_table(t: Tables) -> DataFrame:
    path = scratch_folder(t.spark)
    S.replaced(t.spark, path, t.nation.select(F.col("n_name").alias("name")))
    before = S.replaced(t.spark, path, t.region.select(F.col("r_name").alias("name")))
    now = t.spark.read.parquet(path).count()
    gone = S.emptied(t.spark, path)
    return t.spark.createDataFrame([("replaced", before, now), ("emptied", gone, t.spark.read.parquet(path).count())], "step string, before long, now long")


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders")
def schedule_document(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark)
    S.write_json_document(t.orders.select("o_orderkey", "o_orderstatus"), folder, Q.schedule_metadata(t.orders, "o_orderstatus"), "o_orderkey")
    total = t.spark.read.json(f"{folder}/metadata").filter("field = 'Clean row count'").select(F.col("value").alias("total"))
    return t.spark.read.json(f"{folder}/rows").join(F.broadcast(total))


@query("SELECT s_suppkey, s_name FROM supplier")
def json_lists(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark)
    t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")).write.partitionBy("s_nationkey").text(folder)
    return S.json_records(t.spark, folder, "s_suppkey long, s_name string").select("s_suppkey", "s_name")


@query("SELECT id, label, name FROM (SELECT s_suppkey AS id, 'supplier' AS label, s_name AS name FROM supplier) UNION ALL SELECT s_suppkey, 'rel', s_nationkey::VARCHAR FROM supplier")
def graph_round_trip(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark)
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.lit("supplier")).alias("labels"), F.struct("s_name").alias("props"))
    rels = t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("in").alias("type"), F.struct("s_acctbal").alias("props"))
    S.export_graph(nodes, rels, folder)
    a, b = S.import_graph(t.spark, folder)
    return a.select("id", F.col("labels")[0].alias("label"), F.col("props.s_name").alias("name")).unionByName(b.select(F.col("src").alias("id"), F.lit("rel").alias("label"), F.col("dst").cast("string").alias("name")))

"""Operators at sizes where plans change: sampled ranges, coalesced partitions, broadcasts by estimate, many pairs."""

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F


@contextmanager
def settings(spark, **values):
    names = {k.replace("_", "."): v for k, v in values.items()}
    held = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_hold_where_one_plan_reads_its_ranges_twice(spark):
    from dossier.operators import listing as L

    rows = spark.range(0, 300_000, 1, 8).select(F.xxhash64("id").alias("k"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("payload"))
    with settings(spark, spark_sql_shuffle_partitions="64"):
        out = L.numbered(rows, [F.asc("k")])
        got = out.agg(F.count("*"), F.count_distinct("no"), F.min("no"), F.max("no"), F.max("payload")).first()
        turned = out.withColumn("before", F.lag("k").over(Window.orderBy("no"))).filter("k <= before").count()
    assert (*got[:4], turned) == (300_000, 300_000, 1, 300_000, 0)


def test_every_row_of_large_groups_is_asked_about_once(spark):
    import json

    from dossier.operators import extraction as X

    class All:
        def judge(self, payloads):
            return [json.dumps([{"id": x["id"], "twice": 2 * x["item"]} for x in json.loads(p)]) for p in payloads]

    rows = spark.range(0, 200_000, 1, 8).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("size"))
    with settings(spark, spark_sql_shuffle_partitions="64", spark_sql_adaptive_coalescePartitions_parallelismFirst="false", spark_sql_adaptive_coalescePartitions_minPartitionSize="16k", spark_sql_adaptive_advisoryPartitionSizeInBytes="64k"):
        asked = X.grouped_payloads(rows, ["g"], "id", F.col("size"), 7)
        sizes = asked.agg(F.sum(F.size("keys")), F.max(F.size("keys")), F.count("*"), F.min("batch")).first()
        out = X.answers_of_groups(rows, ["g"], "id", F.col("size"), All(), "id bigint, twice bigint", 7)
        wrong = out.filter("not answered or answer.twice <> 2 * size").count()
    assert (tuple(sizes), wrong) == ((200_000, 7, 3 * -(-66_667 // 7), 0), 0)


def test_headers_of_many_sheets_are_not_broadcast(spark):
    from dossier.sources.office import register_titles

    # the planner takes an exploded array for a few bytes, whatever it holds
    sheets = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.array(F.lit(c)).alias("cells")) for r, c in ((1, "Title"), (2, "Layout"))]))
    cells = spark.range(100).select(F.col("id").cast("string").alias("source_file"), F.lit("one").alias("sheet"), sheets.alias("r")).select("source_file", "sheet", "r.*")
    out = register_titles(cells)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(str(i), "one", 2, "", "Layout") for i in range(100)}


def test_pairs_of_a_cell_are_made_once_and_not_made_distinct(spark):
    from dossier.operators import matching as M

    one = lambda df, name, a, b: df.select(F.col("id").alias(name), F.array((F.col("id") % 2).cast("int"), F.lit(None).cast("int"), F.lit(7)).alias("systems"), F.array(F.lit(a), F.when(F.col("id") % 3 == 0, b), F.lit(a)).alias("phases"))
    left, right = one(spark.range(5000), "query_id", "x", "y"), one(spark.range(9000), "activity_id", "x", "z")
    out = M.cells(left.union(left), right)
    shown = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not shown[0].startswith("Aggregate")  # pairs are not shuffled once more
    got = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.hash("query_id", "activity_id").cast("long")).alias("h")).collect()
    want = spark.range(5000).crossJoin(spark.range(9000).withColumnRenamed("id", "o")).agg(F.sum(F.hash("id", "o").cast("long"))).first()[0]
    assert (sum(r["n"] for r in got), sum(r["h"] for r in got)) == (45_000_000, want)
    assert len(got) > 4 and max(r["n"] for r in got) < 45_000_000 / 2


def test_competing_rules_of_one_subtype_are_dealt_over_tasks(spark, monkeypatch):
    from dossier.operators import matching as M

    monkeypatch.setattr(M, "CELL_ROWS", (100, 200), raising=False)

    i = F.col("id")
    scope = F.when(i % 5 == 0, F.array(F.lit("a"), F.lit(None), F.lit("a"), F.lit("b"))).when(i % 5 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.concat(F.lit("k"), i % 100)))
    rules = spark.range(6000).select(i.alias("rule_id"), F.lit("s").alias("subtype"), scope.alias("scope"), F.when(i % 4 > 0, i % 4).alias("timeline"), (i % 3 == 0).alias("generic"))
    a, b = rules.filter("generic").alias("a"), rules.filter("not generic").alias("b")
    want = a.join(b, F.arrays_overlap("a.scope", "b.scope") & ~F.expr("a.timeline <=> b.timeline")).select("a.rule_id", F.col("b.rule_id").alias("other_id"))
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        out = M.competing_rules(rules)
        assert "arrays_overlap" not in out._jdf.queryExecution().optimizedPlan().toString()  # they meet by scope key
        assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
        assert len(out.groupBy(F.spark_partition_id()).count().collect()) > 4


def test_ladders_clean_each_text_once(spark):
    from dossier.operators import standard_list as B

    rows = spark.range(10).select("id", *[F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in B.FIELDS])
    plan = B.with_standard_facets(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("가-힣") < 40  # a cleaning pattern for each key, not for each marker


def test_rows_of_one_id_keep_their_own_answers(spark):
    import json

    from dossier.operators import extraction as X

    class All:
        def judge(self, payloads):
            return [json.dumps([{"id": x["id"], "twice": 2 * x["item"]} for x in json.loads(p)] + [{"id": 2, "twice": -1}]) for p in payloads]

    rows = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 1, 12), ("a", 2, 13), ("b", 3, 14), (None, 1, 15)], "g string, id long, size long")
    out = X.answers_of_groups(rows, ["g"], "id", F.col("size"), All(), "id bigint, twice bigint", 7)
    assert sorted((r["size"], r["answer"]["twice"]) for r in out.collect()) == [(n, 2 * n) for n in range(10, 16)]


def test_documents_described_alike_go_through_the_schedule_once(spark, monkeypatch):
    from dossier.operators import schedule as S
    from dossier.operators.providers import HashEmbedder, OverlapScorer
    from dossier.plans.schedule import ACTIVITIES, RULES

    cases = [("HRSG General Arrangement Drawing", "HRSG", None, None, "GA", "accepted", "0.9"), ("Quay wall photographs", None, None, None, None, "accepted", None), (None, None, None, None, None, None, None)]
    docs = [(i, *cases[i % 3]) for i in range(30)] + [(0, *cases[1]), (None, *cases[0])]  # a repeated id, a null one
    docs = spark.createDataFrame(docs, "doc_id long, title string, equipment string, system string, building string, deliverable string, candidate_status string, match_score string")
    rules = spark.createDataFrame([*RULES[:2]], "rule_id int, priority int, item string, doc_keyword string, activity_keywords array<string>, sub_type string, formula string").withColumn("vt", S.D.parse_validation_time("formula"))
    activities = spark.createDataFrame([*ACTIVITIES[:3]], "activity_id long, activity_name string, wbs_path string, start_date date, finish_date date")
    went, described = [], S.described
    monkeypatch.setattr(S, "described", lambda rows: went.append(rows.count()) or described(rows))
    found = S.generate_schedule(docs, rules, activities, OverlapScorer(), HashEmbedder(16))
    got = found.groupBy("doc_id", "title", "rule_id").count().collect()
    expected = {(i, (cases[i % 3][0] or ""), 1 if i % 3 == 0 else None) for i in range(30)} | {(0, cases[1][0], None), (None, cases[0][0], 1)}
    assert went == [3] and {tuple(r)[:3] for r in got} == expected and all(r["count"] == 1 for r in got)


def test_rows_of_equal_fields_go_through_the_ladders_once(spark, monkeypatch):
    from dossier.operators import standard_list as B

    cases = [("Pump Layout", None), ("Pump Layout", ""), ("Drawing drawing of pumps", "CEP")]
    rows = spark.createDataFrame([(i % 5, *cases[i % 3], "kept") for i in range(30)], "id int, title string, equipment string, discipline string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in B.FIELDS if c not in rows.columns})
    went, facets = [], B._facets
    monkeypatch.setattr(B, "_facets", lambda found: went.append(found.count()) or facets(found))
    out = B.with_standard_facets(rows)
    with settings(spark, spark_sql_debug_maxToStringFields="10000"):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert went == [3] and plan.count("regexp_replace(") < 120
    assert out.columns == [*rows.columns, *[x for x in B.FACETS if x != "discipline"]]
    got = {(r["title"], r["equipment"], r["discipline"], r["standard_title"]): r["count"] for r in out.groupBy("title", "equipment", "discipline", "standard_title").count().collect()}
    assert got == {("Pump Layout", None, "Mechanical", "Plant General Layout Drawing"): 10, ("Pump Layout", "", "Mechanical", "Plant General Layout Drawing"): 10, ("Drawing drawing of pumps", "CEP", "Mechanical", "CEP Drawing"): 10}


def test_rows_meet_their_texts_with_nulls_alike_whether_those_are_few_or_not(spark):
    from dossier.operators import listing as L

    kinds = [("a", None), (None, None), ("a", "b"), ("", None), (None, "")]
    rows = spark.createDataFrame([(i, *kinds[i % 5]) for i in range(100)], "id int, x string, y string")
    found = spark.createDataFrame([(*k, str(k)) for k in kinds], "x string, y string, said string")
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        for n, broadcast in ((5, True), (L.FEW_ROWS + 1, False)):
            out = L.joined_alike(rows, found, ["x", "y"], n)
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert ("BroadcastHashJoin" in plan) == broadcast and "NestedLoop" not in plan and "Cartesian" not in plan
            assert out.columns == ["id", "x", "y", "said"] and sorted(tuple(r) for r in out.collect()) == [(i, *kinds[i % 5], str(kinds[i % 5])) for i in range(100)]

"""Reports and run comparisons over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import reasons
from dossier.operators import reporting as R
from dossier.plans.registry import Tables, query


@query("""SELECT value, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percent FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'EMPTY' ELSE o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1)""")
def value_counts_pct(t: Tables) -> DataFrame:
    return R.value_counts(t.orders.select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p")), "p")


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY 1""")
def explode_reasons(t: Tables) -> DataFrame:
    found = reasons((F.col("l_discount") > 0.05, "discounted"), (F.col("l_tax") == 0, "untaxed"), (F.col("l_returnflag") == "R", "returned"))
    return R.reason_counts(t.lineitem.select(F.array_join(found, ";").alias("r")), "r")


RUNS = """b AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'generated' WHEN 'O' THEN 'no_rule' ELSE 'skip' END AS s FROM orders),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'generated' WHEN o_orderkey % 11 = 0 THEN 'skip' ELSE s END AS s FROM b WHERE o_orderkey % 13 <> 0)"""


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("o_orderstatus") == "F", "generated").when(F.col("o_orderstatus") == "O", "no_rule").otherwise("skip")
    base = t.orders.select("o_orderkey", kind.alias("s"))
    k = F.col("o_orderkey")
    return base, base.filter(k % 13 != 0).withColumn("s", F.when(k % 10 == 0, "generated").when(k % 11 == 0, "skip").otherwise(F.col("s")))


@query(f"WITH {RUNS}, x AS (SELECT s AS value, count(*) AS base_n FROM b GROUP BY 1), y AS (SELECT s AS value, count(*) AS new_n FROM n GROUP BY 1) SELECT value, coalesce(base_n, 0) AS base_n, coalesce(new_n, 0) AS new_n, coalesce(new_n, 0) - coalesce(base_n, 0) AS delta FROM x FULL JOIN y USING (value)")
def run_diff_counts(t: Tables) -> DataFrame:
    return R.run_delta(*_runs(t), "s")


@query(f"WITH {RUNS} SELECT count(*) FILTER (b.s <> 'generated' AND n.s = 'generated') AS gained, count(*) FILTER (b.s = 'generated' AND n.s <> 'generated') AS lost, count(*) FILTER (b.s <> n.s) AS changed, count(*) AS compared FROM b JOIN n USING (o_orderkey)")
def run_diff_transitions(t: Tables) -> DataFrame:
    return R.transitions(*_runs(t), "o_orderkey", "s")


@query("""WITH b AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders), n AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o_custkey, position, b.k AS base_key, n.k AS new_key, b.k <> n.k AS drift FROM b JOIN n USING (o_custkey, position)""")
def positional_run_diff(t: Tables) -> DataFrame:
    return R.run_alignment(t.orders, t.orders.filter("o_orderkey % 13 <> 0"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""")
def score_stats_percentiles(t: Tables) -> DataFrame:
    return R.score_stats(t.lineitem, ["l_returnflag"], "l_extendedprice")


_MODES = """m AS (SELECT o_orderkey, unnest(['text', 'structured', 'hybrid']) AS mode, o_custkey, o_totalprice, o_orderpriority FROM orders),
s AS (SELECT o_orderkey, mode, o_orderpriority, CASE WHEN mode = 'structured' AND o_custkey % 5 = 0 THEN NULL WHEN mode = 'text' AND o_custkey % 11 = 0 THEN NULL ELSE round(o_totalprice / 100000, 2) + CASE mode WHEN 'text' THEN 0 WHEN 'hybrid' THEN (o_custkey % 3 - 1) / 4.0 ELSE 0.5 END END::DOUBLE AS score,
  CASE WHEN mode = 'text' OR o_custkey % 4 > 0 THEN o_orderkey % 7 END AS choice FROM m)"""


def _modes(t: Tables) -> DataFrame:
    k, mode = F.col("o_custkey"), F.col("mode")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.explode(F.array(*[F.lit(m) for m in ("text", "structured", "hybrid")])).alias("mode"))
    missing = ((mode == "structured") & (k % 5 == 0)) | ((mode == "text") & (k % 11 == 0))
    more = F.when(mode == "text", 0.0).when(mode == "hybrid", (k % 3 - 1) / 4.0).otherwise(0.5)
    return rows.withColumns({"score": F.when(~missing, F.round(F.col("o_totalprice") / 100000, 2) + more), "choice": F.when((mode == "text") | (k % 4 > 0), F.col("o_orderkey") % 7)})


@query(f"""WITH {_MODES}, b AS (SELECT o_orderkey, score AS bs, choice AS bc FROM s WHERE mode = 'text'), d AS (SELECT s.*, bc, round(score - bs, 9) AS delta FROM s JOIN b USING (o_orderkey))
SELECT mode, count(*) AS rows_total, count(score) AS score_available_rows, round(100.0 * count(score) / count(*), 2) AS score_available_pct, round(avg(score), 4) AS mean, round(quantile_cont(score, 0.1), 4) AS p10, round(quantile_cont(score, 0.5), 4) AS median, round(quantile_cont(score, 0.9), 4) AS p90,
  round(avg(delta), 4) AS mean_delta, round(quantile_cont(delta, 0.5), 4) AS median_delta, count(*) FILTER (delta > 0) AS positive_delta_rows, count(*) FILTER (delta < 0) AS negative_delta_rows, count(*) FILTER (delta = 0) AS zero_delta_rows, count(*) FILTER (choice IS DISTINCT FROM bc) AS choice_changed_rows FROM d GROUP BY 1""")
def score_gaps_of_modes(t: Tables) -> DataFrame:
    return R.score_gaps(_modes(t), "o_orderkey", "mode", "score", "choice", "text")


@query(f"""WITH {_MODES}, b AS (SELECT o_orderkey, score AS bs FROM s WHERE mode = 'text'), d AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'EMPTY' ELSE o_orderpriority END AS reason, round(score - bs, 9) AS delta FROM s JOIN b USING (o_orderkey) WHERE mode = 'hybrid'),
g AS (SELECT reason, count(delta) AS n, round(avg(delta), 4) AS mean, round(quantile_cont(delta, 0.5), 4) AS median FROM d GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, median DESC, reason) AS position FROM g""")
def score_gaps_by_reason(t: Tables) -> DataFrame:
    modes = _modes(t)
    base = modes.filter("mode = 'text'").select("o_orderkey", F.col("score").alias("base"))
    rows = modes.filter("mode = 'hybrid'").join(base, "o_orderkey").select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).otherwise(" ").alias("reason"), F.round(F.col("score") - F.col("base"), 9).alias("delta"))
    return R.gaps_by_reason(rows, "reason", "delta")


@query("""WITH v AS (SELECT DISTINCT o_totalprice / 500000 AS v FROM orders WHERE o_totalprice / 500000 BETWEEN 0.4 AND 0.9), g AS (SELECT v, lag(v) OVER (ORDER BY v) AS p FROM v) SELECT round(coalesce(arg_max((v + p) / 2, (round(v - p, 12), -v)), 0.7), 3) AS tau FROM g WHERE p IS NOT NULL""")
def tau_gap(t: Tables) -> DataFrame:
    return R.suggested_threshold(t.orders.select((F.col("o_totalprice") / 500000).alias("v")), "v")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 3 THEN 'not_in_raw_matching' WHEN l_linenumber > 6 THEN 'rank_beyond_top_n' WHEN l_discount < 0.02 THEN 'below_score_threshold' WHEN l_tax > 0.07 THEN 'not_kept_after_candidate_extraction' WHEN l_returnflag <> 'A' THEN 'candidate_needs_review' WHEN l_linestatus = 'O' THEN 'not_generated' ELSE 'kept_and_generated' END AS stage FROM lineitem""")
def drop_stage(t: Tables) -> DataFrame:
    c = F.col
    stage = R.drop_stage(c("l_quantity") >= 3, c("l_linenumber") <= 6, c("l_discount") >= 0.02, c("l_tax") <= 0.07, F.when(c("l_returnflag") == "A", " Accepted ").otherwise("needs_review"), c("l_linestatus") != "O")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stage.alias("stage"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 9 = 0 THEN 'skip' ELSE 'generated' END AS ds, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'kw' END AS kw, ['report', 'list', ''][1 + o_orderkey % 3] AS qf, ['report', 'painting', 'list', ''][1 + o_custkey % 4] AS rf, o_orderkey % 4 AS sh, o_custkey % 3 AS ss, o_custkey % 2 = 0 AS hs FROM orders),
r AS (SELECT o_orderkey, list_filter([CASE WHEN ds <> 'generated' THEN 'date_status=' || CASE WHEN ds = '' THEN 'blank' ELSE ds END END, CASE WHEN kw = '' THEN 'missing_rule_keyword' END, CASE WHEN qf <> '' AND rf <> '' AND qf <> rf THEN 'deliverable_family_mismatch:' || qf || '->' || rf END,
  CASE WHEN rf IN ('painting', 'foundation') AND qf <> rf THEN 'severe_rule_family:' || rf END, CASE WHEN sh = 0 THEN 'rule_token_no_overlap' END, CASE WHEN hs AND ss = 0 THEN 'activity_scope_no_overlap' END], lambda v: v IS NOT NULL) AS w FROM x)
SELECT o_orderkey, CASE WHEN len(list_filter(w, lambda v: starts_with(v, 'date_status=') OR starts_with(v, 'severe_rule_family:') OR contains(v, 'painting') OR contains(v, 'foundation'))) > 0 THEN 'high' WHEN len(w) > 0 THEN 'medium' ELSE 'low' END AS level, coalesce(list_aggregate(w, 'string_agg', ';'), '') AS reasons FROM r""")
def risk_level(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda vs, k: F.element_at(F.array(*[F.lit(v) for v in vs]), (k % len(vs) + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "").when(o % 9 == 0, "skip").otherwise("generated")
    r = R.risk(status, F.when(o % 17 == 0, "").otherwise("kw"), pick(("report", "list", ""), o), pick(("report", "painting", "list", ""), c), o % 4, c % 3, c % 2 == 0)
    return t.orders.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.level", "r.reasons")


_D = ("generated", "fi_complete", "skip", "missing_fa", "no_rule", "blocked_rule", "", "odd")
_Q = ("usable", "skip", "blocked_missing_date", "blocked_no_rule", "blocked_activity")


@query("""WITH x AS (SELECT o_orderkey, [""" + ", ".join(f"'{d}'" for d in _D) + "][1 + o_orderkey % 8] AS d, [" + ", ".join(f"'{q}'" for q in _Q) + """][1 + o_custkey % 5] AS q FROM orders)
SELECT o_orderkey, CASE WHEN d = 'generated' THEN 'generated' WHEN d = 'fi_complete' THEN 'fi_complete' WHEN d = 'skip' OR q = 'skip' THEN 'skip' WHEN d IN ('missing_fa', 'blocked_missing_date') OR q = 'blocked_missing_date' THEN 'partial' WHEN d IN ('no_rule', 'blocked_no_rule') OR q = 'blocked_no_rule' THEN 'no_rule' WHEN starts_with(d, 'blocked') OR starts_with(q, 'blocked') THEN 'blocked' ELSE 'review' END AS bucket FROM x""")
def usability_bucket(t: Tables) -> DataFrame:
    pick = lambda vs, k: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col(k) % len(vs) + 1).cast("int"))
    return t.orders.select("o_orderkey", R.usability(pick(_D, "o_orderkey"), pick(_Q, "o_custkey")).alias("bucket"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'not_blocked' WHEN c_mktsegment = 'BUILDING' THEN 'no_scope' WHEN c_custkey % 7 = 0 THEN 'no_phase' WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey) THEN 'system_absent' WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 3 = c_custkey % 3) THEN 'cell_covered' ELSE 'phase_gap' END AS bucket FROM customer""")
def coverage_buckets(t: Tables) -> DataFrame:
    cells = t.supplier.select("s_nationkey", (F.col("s_suppkey") % 3).alias("phase")).distinct()
    known = cells.groupBy("s_nationkey").agg(F.collect_set("phase").alias("phases"))
    both = t.customer.join(known, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    c = F.col
    return both.select("c_custkey", R.coverage_bucket(c("c_acctbal") >= 0, c("c_mktsegment") != "BUILDING", c("c_custkey") % 7 != 0, c("phases").isNotNull(), F.array_contains("phases", c("c_custkey") % 3)).alias("bucket"))


@query("""SELECT unnest(['rows', 'returned', 'mean_quantity']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (l_returnflag = 'R')::DOUBLE, round(avg(l_quantity), 6)::DOUBLE]) AS value FROM lineitem""")
def run_summary(t: Tables) -> DataFrame:
    return R.metrics(t.lineitem, rows=F.count(F.lit(1)), returned=F.count_if(F.col("l_returnflag") == "R"), mean_quantity=F.round(F.avg("l_quantity"), 6))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'Scope Mixed' END, CASE WHEN o_orderstatus = 'P' THEN 'Generic Title' END], lambda x: x IS NOT NULL)) AS issue FROM orders""")
def validation_explode(t: Tables) -> DataFrame:
    found = reasons((F.col("o_totalprice") > 200000, "Scope Mixed"), (F.col("o_orderstatus") == "P", "Generic Title"))
    return R.validation_rows(t.orders.select("o_orderkey", F.when(F.size(found) == 0, "OK").otherwise(F.array_join(found, "; ")).alias("s")), "s", "o_orderkey")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 4 AS lv, event_type FROM events),
s AS (SELECT *, """ + ", ".join(f"max(CASE WHEN lv = {k} THEN event_id END) OVER w AS p{k}, arg_max(CASE WHEN lv = {k} THEN event_type END, CASE WHEN lv = {k} THEN event_id END) OVER w AS v{k}" for k in range(3)) + """ FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, v0 AS level_0, CASE WHEN NOT coalesce(p0 > p1, false) THEN v1 END AS level_1, CASE WHEN NOT coalesce(p0 > p2, false) AND NOT coalesce(p1 > p2, false) THEN v2 END AS level_2 FROM s""")
def wbs_carry_forward(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", (F.col("event_id") % 4).alias("lv"), "event_type")
    return R.carry_forward(rows, ["user_id"], "event_id", "lv", "event_type", 3).select("event_id", "level_0", "level_1", "level_2")


@query("SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5)::INT AS batch, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5)::INT AS place FROM events")
def batching(t: Tables) -> DataFrame:
    return R.batches(t.events, ["user_id"], [F.asc("event_id")], 5).select("event_id", "batch", "place")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY regexp_matches(s, '^[0-9]+$') DESC, try_cast(s AS BIGINT), s, p_partkey) AS position FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'A' || p_size ELSE p_size::VARCHAR END AS s FROM part)""")
def section_sort(t: Tables) -> DataFrame:
    from dossier.functions.columns import ranked

    rows = t.part.withColumn("s", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("A"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")))
    return rows.select("p_partkey", ranked(["p_type"], *R.section_order("s"), F.asc("p_partkey")).alias("position"))


@query("SELECT user_id, count(*) AS n_events, string_agg(event_id::VARCHAR, '|' ORDER BY event_id) AS ids, round(sum(value), 6) AS total FROM events GROUP BY 1")
def token_accounting(t: Tables) -> DataFrame:
    from dossier.functions.columns import ordered_values

    ids = F.array_join(F.transform(ordered_values("event_id", "event_id"), lambda x: x.cast("string")), "|")
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), ids.alias("ids"), F.round(F.sum("value"), 6).alias("total"))

"""Display strings, chunking, catalog and graph operations, and model-backed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import candidates as C
from dossier.operators import chunking as K
from dossier.operators import filters as P
from dossier.operators import providers as M
from dossier.plans.registry import Tables, query
from dossier.sources import files as S


@query("""SELECT o_orderkey, '[' || o_orderpriority || '] SAU' || o_orderkey || '-1 - PUMP - LAYOUT ' || o_custkey || ' (CrossEncoder: ' || printf('%.4f', (o_orderkey % 900 + 1) / 16) || ' / BM25: 0.9000)' AS shown,
round((o_orderkey % 900 + 1) / 16, 4) AS score, 'SAU' || o_orderkey || '-1' AS document_no, 'PUMP' AS equipment, 'LAYOUT ' || o_custkey AS title FROM orders WHERE o_totalprice > 1000""")
def display_round_trip(t: Tables) -> DataFrame:
    number = F.concat(F.lit("SAU"), "o_orderkey", F.lit("-1"))
    shown = C.display_string("o_orderpriority", number, F.concat(F.lit("PUMP - LAYOUT "), "o_custkey"), CrossEncoder=(F.col("o_orderkey") % 900 + 1) / 16, BM25=F.lit(0.9), RRF=F.lit(None))
    rows = t.orders.filter("o_totalprice > 1000").select("o_orderkey", shown.alias("shown"))
    return rows.withColumn("p", C.parse_display("shown")).select("o_orderkey", "shown", "p.*")


@query("""SELECT p_partkey, CASE WHEN len(i) = 0 THEN 'accepted' ELSE 'needs_review' END AS status, coalesce(list_aggregate(i, 'string_agg', ';'), '') AS issues FROM (SELECT p_partkey, list_filter([CASE WHEN p_size % 6 = 0 THEN 'missing_title' END,
CASE WHEN p_size % 4 = 0 AND NOT (p_size % 6 <> 0 AND p_size % 5 <> 0 AND p_size % 3 = 0) THEN 'missing_scope' END, CASE WHEN p_size % 5 = 0 THEN 'missing_deliverable' END], lambda x: x IS NOT NULL) AS i FROM part)""")
def candidate_issues(t: Tables) -> DataFrame:
    s = F.col("p_size")
    title = F.when(s % 6 == 0, "").when(s % 3 == 0, "PLANT OVERALL VIEW").otherwise("PUMP VIEW")
    q = C.candidate_quality(title, F.when(s % 4 == 0, "").otherwise(F.col("p_brand")), F.when(s % 5 == 0, "").otherwise(F.col("p_type")), F.lit("pump"))
    return t.part.select("p_partkey", q.alias("q")).select("p_partkey", "q.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 10 + greatest(0, 21 - l_linenumber) * 0.003 + CASE WHEN l_returnflag <> 'N' THEN 0.015 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 0.015 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 0.01 ELSE 0 END + l_tax, 6)::DOUBLE AS score FROM lineitem""")
def selection_score(t: Tables) -> DataFrame:
    blank_if = lambda c, v: F.when(F.col(c) == v, "").otherwise(F.col(c))
    score = C.selection_score(F.col("l_discount") * 10, "l_linenumber", blank_if("l_returnflag", "N"), blank_if("l_linestatus", "O"), F.when(F.col("l_returnflag") == "A", "accepted").otherwise("x"), "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey % 50 BETWEEN 10 AND 20 OR o_orderkey % 50 BETWEEN 10 AND 20""")
def page_overlap_filter(t: Tables) -> DataFrame:
    pages = F.array((F.col("o_custkey") % 50).cast("int"), (F.col("o_orderkey") % 50).cast("int"))
    return t.orders.filter(P.touches_pages(pages, 10, 20)).select("o_orderkey")


@query("SELECT 'late' AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_orderstatus <> 'P'")
def boundary_rejection(t: Tables) -> DataFrame:
    kept, rejected = P.split_rows(t.orders, F.col("o_orderstatus") == "P")
    out = P.rejection(rejected, "late").select("reason").unionAll(kept.select(F.lit("kept").alias("reason")))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, len(l) AS n_lines, sum_words AS n_words FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda x: trim(x) <> '') AS l FROM documents) d,
LATERAL (SELECT sum(len(regexp_split_to_array(trim(x), '\s+')))::BIGINT AS sum_words FROM (SELECT unnest(l) AS x)) WHERE len(l) > 0""")
def chunk_totals(t: Tables) -> DataFrame:
    """Chunking keeps each line and word of a text; a chunk that starts inside a line adds none."""
    chunks = K.packed_paragraphs(t.documents, "doc_id", "text", 100)
    return chunks.groupBy("doc_id").agg(F.sum(F.size(F.split("text", "\n")) - F.col("continues").cast("int")).alias("n_lines"), F.sum("token_count").cast("long").alias("n_words"))


@query(r"""WITH RECURSIVE h1 AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS x FROM pages),
h2 AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(p|div|li|h[1-6]|tr|title|nav|ul|ol|table|section|article)>|<br ?/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM h1),
h3 AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM h2),
h4 AS (SELECT page_id, string_split(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), chr(10)) AS ls FROM h3),
ln AS (SELECT page_id, pos, trim(line) AS line FROM (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM h4) WHERE trim(line) <> ''),
wd AS (SELECT page_id, pos, line, string_split_regex(line, '[ \t\x0b\f\r]+') AS ws FROM ln),
pc AS (SELECT page_id, pos, i, CASE WHEN len(ws) <= 64 THEN line ELSE array_to_string(ws[i * 64 + 1:(i + 1) * 64], ' ') END AS t, len(ws[i * 64 + 1:(i + 1) * 64]) AS n FROM (SELECT *, unnest(range(0, (len(ws) + 63) // 64)) AS i FROM wd)),
sq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, i) AS seq FROM pc),
rec AS (SELECT page_id, seq, 0 AS chunk, n AS tok FROM sq WHERE seq = 1
  UNION ALL SELECT s.page_id, s.seq, CASE WHEN s.i = 0 AND r.tok + s.n <= 64 THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN s.i = 0 AND r.tok + s.n <= 64 THEN r.tok + s.n ELSE s.n END FROM rec r JOIN sq s ON s.page_id = r.page_id AND s.seq = r.seq + 1),
ch AS (SELECT page_id, chunk, string_agg(t, chr(10) ORDER BY seq) AS text, sum(n) AS n FROM rec JOIN sq USING (page_id, seq) GROUP BY ALL)
SELECT page_id AS doc_id, chunk::INT AS chunk_index, text, n::INT AS token_count, page_id || '_chunk_' || lpad(chunk::VARCHAR, 6, '0') || '_' || sha256(text)[1:12] AS chunk_id FROM ch""")
def page_chunks(t: Tables) -> DataFrame:
    """Visible paragraphs of web pages, packed up to 64 words."""
    pages = t.pages.select("page_id", K.html_text("html").alias("text"))
    return K.chunk_paragraphs(pages, "page_id", "text", 64)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer""")
def catalog_upsert(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(0).alias("pos"))
    new = base.filter("id % 3 = 0").withColumn("segment", F.lit("old"))
    return S.upsert(base, new.unionAll(new.select("id", F.lit("new"), F.lit(1))), "id", "pos").select("id", "segment")


@query("SELECT 'node' AS kind, 'customer:vip' AS name, count(*) FILTER (c_acctbal > 9000)::BIGINT AS left_n, count(*) FILTER (c_acctbal > 9000 AND c_custkey % 2 = 0)::BIGINT AS right_n FROM customer")
def graph_verify(t: Tables) -> DataFrame:
    nodes = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.array(F.lit("vip"), F.lit("customer")).alias("labels"))
    rels = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("placed").alias("type"))
    return S.graph_differences((nodes, rels), (nodes.filter("id % 2 = 0"), rels))


@query("SELECT p_name, min(p_partkey) AS first_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_violations(t: Tables) -> DataFrame:
    return S.unique_violations(t.part, "p_name").join(t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first_id")), "p_name").select("p_name", "first_id", "n")


@query("""WITH n AS (SELECT DISTINCT p_type AS section FROM part), r AS (SELECT p_type AS section, 2 AS kind, p_partkey AS place, [p_partkey::VARCHAR, p_name] AS cells FROM part)
SELECT section, 0 AS kind, 0 AS place, [section] AS cells FROM n UNION ALL SELECT section, 1, 0, ['p_partkey', 'p_name'] FROM n UNION ALL SELECT * FROM r""")
def sectioned_sheet(t: Tables) -> DataFrame:
    return S.sectioned(t.part, "p_type", ["p_partkey", "p_name"], "p_partkey")


@query()
def embedded_titles(t: Tables) -> DataFrame:
    titles = t.part.select("p_name").distinct()
    return M.embed_texts(titles, "p_name", M.HashEmbedder(16))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 'yes' ELSE 'no' END AS answer FROM conversations")
def judged_turns(t: Tables) -> DataFrame:
    return M.judge_rows(t.conversations.select("conv_id", "turn", "text"), "text", M.KeywordJudge(["the"])).select("conv_id", "turn", "answer")


@query("""WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower('small ' || p_type || ' ring'), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS pair_score FROM w""")
def pair_scores(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", F.concat(F.lit("small "), "p_type", F.lit(" ring")).alias("other"))
    return M.score_pairs(rows, "p_name", "other", M.OverlapScorer()).select("p_partkey", F.round("pair_score", 6).alias("pair_score"))


@query("SELECT s_suppkey, s_nationkey, s_nationkey <> 7 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) AS known FROM supplier")
def closed_set(t: Tables) -> DataFrame:
    selected = t.supplier.select("s_suppkey", "s_nationkey")
    good, bad = M.closed_selection(selected, t.nation.filter("n_nationkey < 20 and n_nationkey <> 7").select(F.col("n_nationkey").alias("s_nationkey")), ["s_nationkey"])
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))


@query()
def phrase_similarity(t: Tables) -> DataFrame:
    pairs = t.part.select("p_name", "p_type").distinct()
    return M.concept_similarity(pairs, "p_name", "p_type", M.HashEmbedder(16))

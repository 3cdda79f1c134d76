"""Keyword, vector and hybrid retrieval over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import vocabulary as V
from dossier.operators import evaluation as E
from dossier.operators import retrieval as R
from dossier.operators import shortlist as L
from dossier.plans.registry import Tables, query
from dossier.sources.scratch import settled

BM25 = """
dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
dl AS (SELECT doc_id, len(ts) AS dl FROM dt),
tot AS (SELECT count(*) AS n_docs, greatest(avg(dl), 1.0) AS avgdl FROM dl),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
qq AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM dt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
bm AS (
  SELECT qq.query_id, tf.doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qq JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), tot GROUP BY ALL),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)
"""
COSINE = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
cs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs)
"""


def keyword_ranking(t: Tables, k: int) -> DataFrame:
    return R.bm25_top_k(t.documents, t.benchmark, k, "doc_id", "text", "item_id", "text")


def vector_ranking(t: Tables, k: int) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    return R.vector_top_k(t.embeddings, t.embeddings.filter("vec_id % 20 = 0"), k, "vec_id", "embedding")


def hybrid_ranking(t: Tables) -> DataFrame:
    """The search is over before its ranking is joined, so that a task holds either vectors or sorted rows."""
    return R.fuse_channels(label_ranking(t, 50), settled(vector_ranking(t, 50)), 100)


@query(f"WITH {BM25} SELECT query_id, doc_id, rank, score FROM bt WHERE rank <= 20")
def bm25_topk(t: Tables) -> DataFrame:
    return keyword_ranking(t, 20).select("query_id", "doc_id", "rank", "score")


@query(f"WITH {COSINE} SELECT query_id, doc_id, rank, score FROM ct WHERE rank <= 20")
def vector_topk_exact(t: Tables) -> DataFrame:
    return vector_ranking(t, 20).select("query_id", "doc_id", "rank", "score")


@query(f"""WITH {BM25},
h AS (SELECT query_id, doc_id, rank, score FROM bt WHERE rank <= 50),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dl, doc_id) AS rank, score FROM h JOIN dl USING (doc_id)),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, max(score) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM o) GROUP BY ALL)
SELECT query_id, doc_id, rrf, score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, score DESC, doc_id) AS rank FROM f""")
def rrf_keyword_lists(t: Tables) -> DataFrame:
    """Two keyword lists of one channel: by score, and the same candidates shortest first."""
    from dossier.functions.columns import ranked
    from dossier.functions.text import word_tokens

    first = keyword_ranking(t, 50).select("query_id", "doc_id", "rank", "score")
    lengths = t.documents.select("doc_id", F.size(word_tokens("text")).alias("dl"))
    second = first.drop("rank").join(lengths, "doc_id").withColumn("rank", ranked(["query_id"], F.asc("dl"), F.asc("doc_id")))
    return R.fuse_lists(first.unionByName(second.select("query_id", "doc_id", "rank", "score"))).select("query_id", "doc_id", "rrf", "score", "rank")


HYBRID = """
lab AS (SELECT vec_id AS doc_id, label FROM embeddings),
kw AS (SELECT query_id, cs.doc_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(a.label - b.label), cs.doc_id) AS rank
       FROM cs JOIN lab a ON a.doc_id = cs.query_id JOIN lab b ON b.doc_id = cs.doc_id),
l AS (SELECT query_id, doc_id, rank AS keyword_rank FROM kw WHERE rank <= 50),
r AS (SELECT query_id, doc_id, rank AS semantic_rank FROM ct WHERE rank <= 50),
hy AS (SELECT query_id, doc_id, keyword_rank, semantic_rank, round(coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 9) AS rrf
       FROM l FULL JOIN r USING (query_id, doc_id)),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(keyword_rank, 1073741824), doc_id) AS retrieval_rank FROM hy)
"""


def label_ranking(t: Tables, k: int) -> DataFrame:
    """A second channel over vectors: nearest label first."""
    from dossier.functions.columns import ranked

    from dossier.operators.listing import numbered

    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("doc_label"))
    asked = labels.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_label").alias("label"))
    # the k best of a label lie within k label values of it, and are among the first k of their own value
    values = numbered(labels.select("doc_label").distinct(), [F.asc("doc_label")])
    around = asked.select("label").distinct().join(values, F.col("label") == F.col("doc_label")).select("label", F.explode(F.sequence(F.col("no") - k, F.col("no") + k)).alias("no"))
    first = labels.withColumn("_r", ranked(["doc_label"], F.asc("doc_id"))).filter(F.col("_r") <= k).drop("_r")
    near = around.join(values, "no").join(first, "doc_label")
    best = near.withColumn("rank", ranked(["label"], F.abs(F.col("label") - F.col("doc_label")), F.asc("doc_id"))).filter(F.col("rank") <= k)
    return asked.join(best, "label").select("query_id", "doc_id", "rank", F.lit(0.0).alias("score"))


@query(f"WITH {COSINE}, {HYBRID} SELECT query_id, doc_id, keyword_rank, semantic_rank, rrf, retrieval_rank FROM hr WHERE retrieval_rank <= 100")
def rrf_hybrid(t: Tables) -> DataFrame:
    return hybrid_ranking(t).select("query_id", "doc_id", "keyword_rank", "semantic_rank", "rrf", "retrieval_rank")


@query(f"""WITH {COSINE}, {HYBRID},
p AS (SELECT *, round(1.0 / (1 + abs(query_id - doc_id)), 6) AS pair_score FROM hr WHERE retrieval_rank <= 100)
SELECT query_id, doc_id, pair_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, retrieval_rank) AS final_rank FROM p) WHERE final_rank <= 20""")
def rerank_order(t: Tables) -> DataFrame:
    scored = hybrid_ranking(t).withColumn("pair_score", F.round(1.0 / (1 + F.abs(F.col("query_id") - F.col("doc_id"))), 6))
    return R.rerank(scored, "pair_score", 20).select("query_id", "doc_id", "pair_score", "final_rank")


SCORED = """
qa AS (SELECT o_orderkey AS query_id, o_orderpriority AS q_phase FROM orders WHERE o_orderkey % 20 = 0),
pa AS (SELECT l_orderkey AS query_id, l_linenumber + 8 * l_partkey AS doc_id, max(l_quantity) AS a_score, max(l_extendedprice) AS b_score, max(l_returnflag) AS phase FROM lineitem GROUP BY 1, 2),
pr AS (SELECT * FROM qa JOIN pa USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY a_score DESC, doc_id) AS a_rank, row_number() OVER (PARTITION BY {by} ORDER BY b_score DESC, doc_id) AS b_rank FROM pr)
"""


def _pairs(t: Tables) -> DataFrame:
    """Line items of an order stand for the scored candidates of a query."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") + 8 * F.col("l_partkey")).alias("doc_id"))
    lines = lines.agg(F.max("l_quantity").alias("a_score"), F.max("l_extendedprice").alias("b_score"), F.max("l_returnflag").alias("phase"))
    return t.orders.filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("q_phase")).join(lines, "query_id")


@query(f"""WITH {SCORED.format(by="query_id")},
al AS (SELECT *, (q_phase IN ('1-URGENT', '2-HIGH') AND phase = 'R') AS ok FROM rk),
fb AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM al) WHERE ok OR NOT any_ok),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a_rank, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b_rank, doc_id) AS rb FROM fb),
sc AS (SELECT query_id, doc_id, a_rank, b_rank, round(1.0 / (60 + a_rank) + 1.0 / (60 + b_rank), 9) AS rrf FROM ca WHERE ra <= 3 OR rb <= 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM sc) WHERE rank <= 2""")
def rrf_phase_filtered_global_rank(t: Tables) -> DataFrame:
    allowed = F.col("q_phase").isin("1-URGENT", "2-HIGH") & (F.col("phase") == "R")
    return R.fuse_scored(_pairs(t), allowed, 3, 2).select("query_id", "doc_id", "a_rank", "b_rank", "rrf", "rank")


#: Phases that priorities and return flags stand for.
QUERY_PHASE = {"1-URGENT": "design_criteria", "2-HIGH": "manual", "3-MEDIUM": "delivery", "4-NOT SPECIFIED": "", "5-LOW": "commissioning"}
ACTIVITY_PHASE = {"A": "procurement", "N": "system_design", "R": "delivery"}
_named = lambda x, table: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(f"""WITH {SCORED.format(by="query_id")},
bk AS (SELECT * FROM (VALUES {", ".join(f"('{q}', '{a}')" for q, x in V.PHASE_BUCKETS.items() for a in x)}) AS b(query_phase, activity_phase)),
ph AS (SELECT *, {_named("q_phase", QUERY_PHASE)} AS query_phase, {_named("phase", ACTIVITY_PHASE)} AS activity_phase FROM rk),
al AS (SELECT *, (query_phase, activity_phase) IN (SELECT (query_phase, activity_phase) FROM bk) AS ok FROM ph),
fb AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM al) WHERE ok OR NOT any_ok),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a_rank, doc_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b_rank, doc_id) AS rb FROM fb),
sc AS (SELECT query_id, doc_id, query_phase, activity_phase, round(1.0 / (60 + a_rank) + 1.0 / (60 + b_rank), 9) AS rrf FROM ca WHERE ra <= 3 OR rb <= 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM sc) WHERE rank <= 2""")
def activity_shortlist(t: Tables) -> DataFrame:
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    pairs = _pairs(t).withColumns({"query_phase": table(QUERY_PHASE)[F.col("q_phase")], "activity_phase": table(ACTIVITY_PHASE)[F.col("phase")]})
    return R.activity_shortlist(pairs, 3, 2).select("query_id", "doc_id", "query_phase", "activity_phase", "rrf", "rank")


@query("""WITH x AS (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE ' ' END AS sy, ['Layout', 'DATASHEET', 'overview', ''][1 + p_partkey % 4] AS de, ['Layout Drawing', 'Data Sheet', 'overview', ''][1 + p_partkey % 4] AS norm, p_size % 3 AS k FROM part)
SELECT p_partkey, array_to_string(list_filter([p_name, trim(sy), norm, 'T', CASE de WHEN 'Layout' THEN 'Layout Arrangement Drawing' WHEN 'overview' THEN 'System Description overview' ELSE CASE k WHEN 0 THEN 'P.O Procurement transportation delivery FOB' WHEN 1 THEN 'commissioning test' ELSE '' END END], lambda v: v <> ''), ' ') AS q FROM x""")
def activity_query(t: Tables) -> DataFrame:
    s, words = F.col("p_size"), lambda *v: F.array(*[F.lit(x) for x in v])
    deliverable = F.element_at(words("Layout", "DATASHEET", "overview", ""), (F.col("p_partkey") % 4 + 1).cast("int"))
    keywords = F.when(s % 3 == 0, words(" P.O", "other", "FOB")).when(s % 3 == 1, words("Commissioning"))
    return t.part.select("p_partkey", V.activity_query("p_name", F.when(s % 2 == 0, F.col("p_brand")).otherwise(" "), deliverable, F.lit("T"), keywords).alias("q"))


@query(f"""WITH {SCORED.format(by="query_id, phase")},
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, phase ORDER BY a_rank, doc_id) AS ra, row_number() OVER (PARTITION BY query_id, phase ORDER BY b_rank, doc_id) AS rb FROM rk),
sc AS (SELECT query_id, phase, doc_id, a_rank, b_rank, round(1.0 / (60 + a_rank) + 1.0 / (60 + b_rank), 9) AS rrf FROM ca WHERE ra <= 50 OR rb <= 50)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, phase ORDER BY rrf DESC, doc_id) AS rank FROM sc) WHERE rank <= 10""")
def rrf_cell_local_rank(t: Tables) -> DataFrame:
    return R.fuse_scored(_pairs(t), None, 50, 10, local=("query_id", "phase")).select("query_id", "phase", "doc_id", "a_rank", "b_rank", "rrf", "rank")


RECALL = f"""WITH {COSINE},
qr AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
hit AS (SELECT query_id, count(*) AS positives, count(rank) AS hits FROM qr LEFT JOIN (SELECT * FROM ct WHERE rank <= 20) USING (query_id, doc_id) GROUP BY 1),
ev AS (SELECT DISTINCT query_id FROM ct),
pq AS (SELECT query_id, coalesce(positives, 0) AS positives, coalesce(hits, 0) AS hits,
       CASE WHEN positives > 0 THEN round(hits / positives, 6) END AS recall, CASE WHEN positives > 0 THEN (hits > 0)::INT::DOUBLE END AS hit_rate FROM ev LEFT JOIN hit USING (query_id))
"""


def _recall(t: Tables) -> DataFrame:
    return E.recall_of_classes(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), settled(vector_ranking(t, 20)), "label", 20)


@query(RECALL + "SELECT * FROM pq")
def recall_at_k(t: Tables) -> DataFrame:
    return _recall(t)


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS doc_id, l_quantity::INT % 4 AS relevance FROM lineitem), k AS (SELECT query_id, doc_id, max(relevance) AS relevance FROM q GROUP BY ALL),
r AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM r),
g AS (SELECT query_id, count(*) AS positives, count(*) FILTER (rank <= 2) AS hits FROM k JOIN rk USING (query_id, doc_id) WHERE relevance >= 3 GROUP BY 1)
SELECT DISTINCT rk.query_id, coalesce(positives, 0) AS positives, coalesce(hits, 0) AS hits, CASE WHEN positives > 0 THEN round(hits / positives, 6) END AS recall, CASE WHEN positives > 0 THEN (hits > 0)::INT::DOUBLE END AS hit_rate FROM rk LEFT JOIN g USING (query_id)""")
def recall_of_pairs(t: Tables) -> DataFrame:
    """Parts of an order, ranked by price, against judged ones."""
    parts = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_quantity").cast("int") % 4).alias("relevance"), "l_extendedprice")
    judged = parts.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    scored = parts.groupBy("query_id", "doc_id").agg(F.max("l_extendedprice").alias("score"))
    return E.recall_at_k(judged, R.top_k(scored, 1000), 2)


@query(RECALL + "SELECT count(*) AS queries, count(recall) AS positive_queries, round(avg(recall), 6) AS mean_recall, round(avg(hit_rate), 6) AS mean_hit_rate FROM pq")
def metric_summary(t: Tables) -> DataFrame:
    return E.metric_summary(_recall(t))


@query("""WITH
a AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts, ['procurement', 'system_design', 'delivery', 'commissioning'][1 + item_id % 4] AS phase, item_id % 5 AS sys FROM benchmark),
al AS (SELECT item_id, len(ts) AS dl FROM a), tot AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM al),
tf AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(ts) AS token FROM a) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT item_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (token) JOIN al USING (item_id), tot),
qt AS (SELECT doc_id, token, count(*) AS qtf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
kw AS (SELECT doc_id, item_id, round(sum(qtf * w), 6) AS s FROM qt JOIN w USING (token) GROUP BY ALL),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
cs AS (SELECT q.vec_id AS doc_id, d.vec_id AS item_id, round(list_cosine_similarity(q.e, d.e), 6) AS s FROM v q, v d WHERE d.vec_id IN (SELECT item_id FROM benchmark)),
q AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'delivery' WHEN 'de' THEN 'design_drawing' WHEN 'fr' THEN 'civil_design' ELSE '' END AS phase, doc_id % 6 AS sys FROM documents),
al2 AS (SELECT q.doc_id, a.item_id, coalesce(kw.s, 0) AS a_score, coalesce(cs.s, 0) AS b_score, q.sys = a.sys AND a.phase IN ('delivery', 'commissioning') AS cell,
        (q.phase = 'delivery' AND a.phase IN ('delivery', 'procurement')) OR (q.phase = 'design_drawing' AND a.phase IN ('system_design', 'civil_design')) OR (q.phase = 'civil_design' AND a.phase = 'civil_design') AS ok
        FROM q CROSS JOIN a LEFT JOIN kw USING (doc_id, item_id) LEFT JOIN cs USING (doc_id, item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a_score DESC, item_id) AS a_rank, row_number() OVER (PARTITION BY doc_id ORDER BY b_score DESC, item_id) AS b_rank, bool_or(ok) OVER (PARTITION BY doc_id) AS any_ok FROM al2),
tx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a_rank) AS ra, row_number() OVER (PARTITION BY doc_id ORDER BY b_rank) AS rb FROM rk WHERE ok OR NOT any_ok),
ce AS (SELECT * EXCLUDE (a_rank, b_rank), row_number() OVER (PARTITION BY doc_id ORDER BY a_rank) AS a_rank, row_number() OVER (PARTITION BY doc_id ORDER BY b_rank) AS b_rank FROM rk WHERE cell),
un AS (SELECT doc_id, 'text' AS source, item_id, a_score, b_score, a_rank, b_rank FROM tx WHERE ra <= 10 OR rb <= 10 UNION ALL SELECT doc_id, 'cell', item_id, a_score, b_score, a_rank, b_rank FROM ce),
fu AS (SELECT *, round(1.0 / (60 + a_rank) + 1.0 / (60 + b_rank), 9) AS rrf FROM un)
SELECT doc_id AS query_id, source, item_id AS activity_id, a_score, b_score, a_rank, b_rank, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY rrf DESC, item_id) AS rank FROM fu) WHERE rank <= 5""")
def two_channel_shortlist(t: Tables) -> DataFrame:
    """Every document against all items by words and by vectors, in the phases its language is open to and in its cell."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    phases = F.element_at(F.array(*[F.lit(p) for p in ("procurement", "system_design", "delivery", "commissioning")]), (F.col("item_id") % 4 + 1).cast("int"))
    items = t.benchmark.select(F.col("item_id").alias("activity_id"), "text", phases.alias("phase"), F.array((F.col("item_id") % 5).cast("string")).alias("systems"))
    items = items.join(vectors, F.col("activity_id") == F.col("vec_id"), "left").drop("vec_id")
    wanted = F.when(F.col("lang") == "en", "delivery").when(F.col("lang") == "de", "design_drawing").when(F.col("lang") == "fr", "civil_design").otherwise("")
    asked = t.documents.select(F.col("doc_id").alias("query_id"), "text", wanted.alias("phase"), F.array((F.col("doc_id") % 6).cast("string")).alias("systems"), F.array(F.lit("delivery"), F.lit("commissioning")).alias("cell_phases"))
    asked = asked.join(vectors, F.col("query_id") == F.col("vec_id"), "left").drop("vec_id")
    return L.two_channel_shortlist(asked, items, 10, 5)

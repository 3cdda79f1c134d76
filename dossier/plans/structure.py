"""Structured chunks, artifacts of many widths, selections in rounds and taxonomy values of groups."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import elements as K
from dossier.operators import selection as Z
from dossier.operators import taxonomy_context as X
from dossier.plans.registry import Tables, query
from dossier.sources import files as S
from dossier.sources.scratch import scratch_folder

_MOST = 120


@query(rf"""WITH RECURSIVE li AS (SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
el AS (SELECT doc_id, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, place % 7 = 1 AS heading, 1 + place % 3 AS level FROM li),
he AS (SELECT doc_id, place, level, array_to_string(ws, ' ') AS title FROM el WHERE heading AND len(ws) > 0),
pc AS (SELECT doc_id, place, i, ws[i * {_MOST} + 1:(i + 1) * {_MOST}] AS ws FROM (SELECT *, unnest(range(0, (len(ws) + {_MOST} - 1) // {_MOST})) AS i FROM el WHERE NOT heading AND len(ws) > 0)),
sg AS (SELECT p.*, (SELECT coalesce(max(h.place), 0) FROM he h WHERE h.doc_id = p.doc_id AND h.place < p.place) AS seg, row_number() OVER (PARTITION BY doc_id ORDER BY place, i) AS seq FROM pc p),
rec AS (SELECT doc_id, seq, 0 AS chunk, len(ws)::BIGINT AS tok, seg FROM sg WHERE seq = 1
  UNION ALL SELECT s.doc_id, s.seq, CASE WHEN s.seg = r.seg AND r.tok + len(s.ws) <= {_MOST} THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN s.seg = r.seg AND r.tok + len(s.ws) <= {_MOST} THEN r.tok + len(s.ws) ELSE len(s.ws) END, s.seg FROM rec r JOIN sg s ON s.doc_id = r.doc_id AND s.seq = r.seq + 1),
ch AS (SELECT doc_id, chunk, min(rec.seg) AS seg, sum(len(ws)) AS n, string_agg(array_to_string(ws, ' '), chr(10) ORDER BY seq) AS t, min(place) AS first_place, max(place) AS last_place FROM rec JOIN sg USING (doc_id, seq) GROUP BY ALL),
pa AS (SELECT c.doc_id, c.chunk, string_agg(h.title, ' > ' ORDER BY h.place) AS path FROM ch c JOIN he h ON h.doc_id = c.doc_id AND h.place <= c.seg
  WHERE NOT EXISTS (SELECT 1 FROM he g WHERE g.doc_id = h.doc_id AND g.place > h.place AND g.place <= c.seg AND g.level <= h.level) GROUP BY ALL)
SELECT c.doc_id, c.chunk AS chunk_index, md5(t) AS text_md5, n::BIGINT AS token_count, coalesce(path, '') AS path, 1 + first_place // 10 AS page_start, 1 + last_place // 10 AS page_end, first_place, last_place FROM ch c LEFT JOIN pa USING (doc_id, chunk)""")
def element_chunks(t: Tables) -> DataFrame:
    """Lines of documents as elements, every seventh a heading of one of three levels, ten lines a page."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("place", F.col("at") + 1)
    text = F.array_join(F.regexp_extract_all("line", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), " ")
    elements = lines.select("doc_id", "place", F.when(F.col("place") % 7 == 1, "heading").otherwise("paragraph").alias("kind"), (1 + F.col("place") % 3).alias("level"), text.alias("text"), (1 + F.floor(F.col("place") / 10)).alias("page"))
    found = K.chunk_elements(elements, _MOST)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"), F.array_join("headings", " > ").alias("path"), "page_start", "page_end", F.array_min("places").alias("first_place"), F.array_max("places").alias("last_place"))


@query("SELECT page_id, true AS bounded, true AS titled FROM pages")
def page_structure(t: Tables) -> DataFrame:
    """Every page's chunks keep the budget, and what stands below its main heading carries it."""
    elements = K.page_elements(t.pages, "page_id", "html")
    chunks = K.chunk_elements(elements, 64)
    heads = elements.filter("kind = 'heading' and level = 1").select("doc_id", F.col("text").alias("title"), F.col("place").alias("at"))
    both = chunks.join(heads, "doc_id", "left").withColumn("below", F.col("at").isNotNull() & (F.array_min("places") > F.col("at")))
    found = both.groupBy("doc_id").agg((F.max("token_count") <= 64).alias("bounded"), F.bool_and(F.when(F.col("below"), F.element_at("headings", 1) == F.col("title")).otherwise(F.size("headings") == 0)).alias("titled"))
    return t.pages.select("page_id").join(found.withColumn("page_id", F.col("doc_id").cast("long")).drop("doc_id"), "page_id", "left").fillna(True, ["bounded", "titled"])


_WIDTHS = (3, 20, 150)


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS k, [3, 20, 150][1 + s_suppkey % 3] AS width FROM supplier), m AS (SELECT *, unnest(range(1, width + 1)) AS rank FROM s)
SELECT 'part-' || k AS file, s_suppkey::VARCHAR AS chunk_id, rank, CASE WHEN (s_suppkey + rank) % 4 > 0 THEN 'd' || (s_suppkey * rank) END AS display, CASE WHEN k = 1 THEN 'id' || rank END AS doc_id, k::VARCHAR AS mark FROM m WHERE (s_suppkey + rank) % 4 > 0 OR k = 1""")
def artifacts_of_three_widths(t: Tables) -> DataFrame:
    """Files of 3, 20 and 150 matched columns, one of them with ids beside; each is read by its own header, no column is lost."""
    folder, key = scratch_folder(t.spark), F.col("s_suppkey")
    for k, width in enumerate(_WIDTHS):
        shown = [F.when((key + r) % 4 > 0, F.concat(F.lit("d"), (key * r).cast("string"))).otherwise(" ").alias(f"Matched_Doc_{r}") for r in range(1, width + 1)]
        ids = [F.lit(f"id{r}").alias(f"Matched_Doc_{r}_Doc_ID") for r in range(1, width + 1)] if k == 1 else []
        rows = t.supplier.filter(key % 3 == k).select(*shown[::-1], key.cast("string").alias("Chunk ID"), *ids, F.lit(f"doc, {k}\nsecond line").alias("Document"))
        rows.write.csv(f"{folder}/part-{k}", header=True, escape='"')
    found = S.match_artifacts(t.spark, folder, "*.csv").filter("document like 'doc, %\\nsecond line'")
    return found.select(F.regexp_extract("path", "(part-[0-9])/", 1).alias("file"), "chunk_id", "rank", "display", "doc_id", F.substring("document", 6, 1).alias("mark"))


class TryingJudge:
    """Errs by order and attempt: raises, answers no JSON, names an unknown id or another chunk, or never answers."""

    def __init__(self, attempt: int):
        self.attempt = attempt

    def judge(self, payloads: Sequence[str]) -> list[str]:
        out = []
        for p in payloads:
            task = json.loads(p)
            kind, right = task["order"] % 7, json.dumps({"chunk_id": f"c{task['order']}", "selected_doc_ids": [min(task["ids"], key=int)]})
            if kind == 3 or (kind == 0 and self.attempt < 2):
                raise RuntimeError("busy")
            wrong = {1: "sorry", 2: '{"selected_doc_ids": ["x"]}', 4: '{"chunk_id": "c0", "selected_doc_ids": []}', 5: "{}"}.get(kind)
            out.append(wrong if wrong and self.attempt < (3 if kind == 2 else 2) else f"```json\n{right}\n```")
        return out


@query("""WITH o AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE l_orderkey % 7 WHEN 6 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 2 END AS attempt, CASE WHEN l_orderkey % 7 <> 3 THEN p::VARCHAR END AS selected, CASE WHEN l_orderkey % 7 = 3 THEN 'RuntimeError: busy' END AS error FROM o""")
def selection_in_rounds(t: Tables) -> DataFrame:
    """The items of each order; a run is broken off after one round and goes on."""
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("candidates"))
    tasks = orders.select("l_orderkey", F.concat(F.lit("c"), "l_orderkey").alias("chunk_id"), "candidates", F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.col("candidates").alias("ids"))).alias("payload"))
    folder = scratch_folder(t.spark)
    Z.selected_in_rounds(tasks, ["l_orderkey"], TryingJudge, folder, rounds=1)
    found = Z.selected_in_rounds(tasks, ["l_orderkey"], TryingJudge, folder)
    return found.select("l_orderkey", "attempt", F.array_join("selected", ",").alias("selected"), "error")


#: Longer keys win; some lie over the border of two rows only.
_ALIASES = (("RING", "Rings"), ("bolt & red", "Never"), ("BOLT RED", "Red after bolts"), ("RED BOLT OLD", "Old after red bolts"), ("Gizmo Hot-Widget", "Hot widgets after gizmos"), ("never there", "Nothing"))


@query("""WITH g AS (SELECT p_type, p_size, ' ' || string_agg(trim(regexp_replace(replace(upper(p_name), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), ' ' ORDER BY p_partkey) || ' ' AS t FROM part GROUP BY 1, 2)
SELECT p_type, p_size, CASE WHEN contains(t, ' GIZMO HOT WIDGET ') THEN 'Hot widgets after gizmos' WHEN contains(t, ' BOLT AND RED ') THEN 'Never' WHEN contains(t, ' RED BOLT OLD ') THEN 'Old after red bolts' WHEN contains(t, ' NEVER THERE ') THEN 'Nothing'
  WHEN contains(t, ' BOLT RED ') THEN 'Red after bolts' WHEN contains(t, ' RING ') THEN 'Rings' ELSE 'General' END AS value FROM g""")
def taxonomy_of_groups(t: Tables) -> DataFrame:
    """Parts of a type and size as one text, in order of their keys."""
    return X.forced_values(t.part, ["p_type", "p_size"], "p_partkey", ["p_name"], _ALIASES, "General")

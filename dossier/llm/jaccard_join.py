"""N-gram Jaccard self-join by a token-group matrix, with connected components.

Equal sets become one class first. Links among the classes come in two steps:

1. Star links. Classes that share a min-hash are compared with the smallest one
   of that key, so a group of thousands of near copies costs one comparison a
   member. Components of these links are known before anything else is opened.
2. Token-group matrix. Classes are partitioned into groups of similar sets (a
   component, or one min-hash, in hashed parts of about GROUP_SETS). The matrix holds
   which tokens each group's union has. A query class probes it with its prefix
   tokens (rarest first; two sets with a Jaccard of 0.8 share one there), skips
   groups wholly inside its own component, and at each token only classes
   outside the largest component there ask, since a link needs one asker. Where
   the overlap with the group's union can still reach 0.8, the group is opened
   and its members are compared exactly.

Both steps only find true links, and step 2 misses none between components, so
the components are exact. The token order comes from all classes: hash buckets
count every token and answer with twice the logarithm of its count in 6 bits. Tokens
of one class come first and are never probed, so a document that merely quotes
a shared passage has nothing to ask.

Defined results: null texts and texts without words have an empty set and link
with nothing. A row with a null doc_id links with nothing and has a null
component. Rows of one doc_id are one vertex with all their links. Texts of any
length give their whole set; a Jaccard of 0.8 exactly links. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.components import connected_components
from dossier.llm.exact_dedup import free_name
from dossier.llm.frames import documents, settled, volume
from dossier.llm.substring_dedup import ANSWER, SENT, _answers, _cut, _sent, _told, plan_sizes
from dossier.llm.words import mix, slices, span_hashes, spans, texts_of, window_hashes

SHINGLE = 5
PERCENT = 80
SKETCH = 16
STAR_KEYS = 3
SKETCH_AGREES = 10
GROUP_SETS = 64
#: Enough for counts up to 2^31.
RARITY_BITS = 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.ChunkedArray | pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the column."""
    raw_all, at = texts_of(column)
    for lo, hi in slices(at):
        raw, offsets = LOWER[raw_all[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        start, end, _ = spans(raw, offsets)
        words = span_hashes(raw, start, end, seed=21)
        edges = np.searchsorted(start, offsets)
        windows = window_hashes(words, size, seed=22)
        for i in range(hi - lo):
            n = edges[i + 1] - edges[i]
            if n >= size:
                yield np.unique(windows[edges[i] : edges[i + 1] - size + 1])
            else:
                yield window_hashes(words[edges[i] : edges[i + 1]], int(n), seed=22 + int(n)) if n else np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, class) of each row."""
    for batch in batches:
        sizes, classes = [], []
        for tokens in shingle_sets(batch.column(1)):
            sizes.append(len(tokens))
            classes.append(fingerprint(tokens))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary())], ["doc_id", "n", "class"])


def prefix(tokens: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The tokens, rarest first, one of which any set with the wanted Jaccard shares; those of one class left out."""
    least = -(-PERCENT * len(tokens) // 100)
    first = np.lexsort((tokens, rarity))[: len(tokens) - least + 1]
    return tokens[first[rarity[first] > 0]]


def sketch(tokens: np.ndarray) -> np.ndarray:
    return np.array([mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)).min() for k in range(SKETCH)], np.uint64)


def _class_sets(table: pa.Table) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(class, doc_id, tokens) of the classes that the batch stands for; its marker rows name them."""
    marked = {(r["doc_id"], r["class"]) for r in table.filter(pc.is_valid(table["class"])).select(["doc_id", "class"]).to_pylist()}
    texts = table.filter(pc.is_null(table["class"]))
    for doc_id, tokens in zip(texts["doc_id"].to_pylist(), shingle_sets(texts["text"]), strict=True):
        name = fingerprint(tokens)
        if (doc_id, name) in marked:
            marked.remove((doc_id, name))
            yield name, doc_id, tokens


def _tokens(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Classes in order; the distinct tokens; whether two classes have each; each class token's number, one after the other."""
    found = sorted(_class_sets(table), key=lambda x: x[0])
    flat = np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64)
    tokens, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    return found, tokens, n > 1, number


def _send_tokens(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, tokens, several, _ = _tokens(table)
        code = ((tokens >> np.uint64(33 - bits)) & np.uint64((1 << 31) - 1)).astype(np.uint32) << np.uint32(1) | several.astype(np.uint32)
        cuts = [*_cut(tokens, bits)]
        return _sent([c[0] for c in cuts], key[0].as_py(), [code[lo:hi].tobytes() for _, lo, hi in cuts])

    return run


def _count_tokens(table: pa.Table) -> pa.Table:
    """RARITY_BITS bits: 0 for a token of one class, else twice the logarithm of its count (tokens that look alike count as one)."""
    parts = [np.frombuffer(x, np.uint32) for x in table["packed"].to_pylist()]
    code = np.concatenate(parts)
    order = np.argsort(code >> np.uint32(1), kind="stable")
    key = code[order] >> np.uint32(1)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    runs = np.diff(np.append(head, len(key)))
    count = runs + np.add.reduceat((code[order] & 1).astype(np.int64), head)
    level = np.zeros(len(code), np.int64)
    level[order] = np.repeat(np.minimum((1 << RARITY_BITS) - 1, (2 * np.log2(count)).astype(np.int64)), runs)
    return _answers(1, table, [len(p) for p in parts], [(level >> b) & 1 for b in range(RARITY_BITS)])


CLASS = "class binary, rep long, n long, sketch array<long>, probes array<long>, tokens array<long>"


def _keep_linked(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
    found, tokens, _, number = _tokens(table)
    told = _told(answers, 1, len(tokens), RARITY_BITS)
    level = sum(flags.astype(np.int8) << b for b, flags in enumerate(told))[number]
    at, rows = 0, []
    for name, rep, whole in found:
        probes = prefix(whole, level[at : at + len(whole)])
        at += len(whole)
        if len(probes):
            rows.append((name, rep, len(whole), sketch(whole).view(np.int64), probes.view(np.int64), whole.view(np.int64)))
    columns = [[*x] for x in zip(*rows, strict=True)] if rows else [[]] * 6
    longs = pa.list_(pa.int64())
    kinds = (pa.binary(), pa.int64(), pa.int64(), longs, longs, longs)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["class", "rep", "n", "sketch", "probes", "tokens"])


def _alike(inter, n_a, n_b):
    return 100 * inter >= PERCENT * (n_a + n_b - inter)


def _may_be_alike(n_a, n_b):
    """Sizes that allow the wanted Jaccard."""
    return (100 * n_a >= PERCENT * n_b) & (100 * n_b >= PERCENT * n_a)


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """CLASS rows of the classes that share a prefix token with another."""
    batches, bits = plan_sizes(volume(docs)[1])
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    rows = named.select(batch, "doc_id", "text", F.lit(None).cast("binary").alias("class"))
    marks = classes.select(F.col("rep").alias("doc_id"), "class").select(batch, "doc_id", F.lit(None).cast("string").alias("text"), "class")
    by_batch = rows.union(marks).groupBy("batch")
    answers = by_batch.applyInArrow(_send_tokens(bits), SENT).groupBy("bucket").applyInArrow(_count_tokens, ANSWER)
    return settled(by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_keep_linked, CLASS))


def star_links(linked: DataFrame) -> DataFrame:
    """True links (a, b) between a class and the smallest class of one of its min-hash keys."""
    keys = linked.select("class", "rep", "n", "sketch", F.posexplode(F.slice("sketch", 1, STAR_KEYS)).alias("place", "key"))
    centre = F.min(F.struct("rep", "class", "n", "sketch")).alias("centre")
    centres = settled(keys.groupBy("place", "key").agg(centre, F.count(F.lit(1)).alias("size")).filter("size > 1"))
    agree = F.size(F.filter(F.arrays_zip(F.col("sketch").alias("x"), F.col("centre.sketch").alias("y")), lambda z: z["x"] == z["y"]))
    pairs = keys.join(centres, ["place", "key"]).filter((F.col("class") != F.col("centre.class")) & _may_be_alike(F.col("n"), F.col("centre.n")) & (agree >= SKETCH_AGREES))
    pairs = settled(pairs.select("class", F.col("centre.class").alias("other")).distinct())
    own = linked.select("class", "rep", "n", "tokens")
    other = linked.select(F.col("class").alias("other"), F.col("rep").alias("other_rep"), F.col("n").alias("other_n"), F.col("tokens").alias("other_tokens"))
    both = pairs.join(own, "class").join(other, "other")
    inter = F.size(F.array_intersect("tokens", "other_tokens"))
    return settled(both.filter(_alike(inter, F.col("n"), F.col("other_n"))).select(F.col("rep").alias("a"), F.col("other_rep").alias("b")).distinct())


def matrix_links(linked: DataFrame, components: DataFrame) -> DataFrame:
    """All true links (a, b) between classes of different components, by the token-group matrix."""
    known = linked.select("class", "rep", "n", "probes", F.element_at("sketch", 1).alias("hash")).join(components.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.withColumn("cluster", F.when(F.col("component").isNull(), F.xxhash64(F.lit(1), "hash")).otherwise(F.xxhash64(F.lit(2), "component")))
    known = settled(known.withColumn("component", F.coalesce("component", "rep")))
    parts = settled(known.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / GROUP_SETS).cast("int").alias("parts")))
    placed = settled(known.join(parts, "cluster").withColumn("group", F.xxhash64("cluster", F.pmod(F.xxhash64("class"), F.col("parts")))).drop("cluster", "parts", "hash"))
    # probes end the prefix of each set's order; `rest` counts the tokens from a probe on
    length = F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1
    probes = placed.select("class", "n", "component", "group", length.alias("length"), F.size("probes").alias("k"), F.posexplode("probes").alias("at", "token"))
    probes = probes.select("class", "n", "component", "group", "token", (F.col("n") - (F.col("length") - F.col("k") + F.col("at"))).alias("rest"))

    # who asks: at each token all but the component with most classes there
    weight = probes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("token")
    largest = settled(weight.agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("sides")).filter("sides > 1").select("token", "largest"))
    asked = settled(probes.join(largest, "token"))
    matrix = settled(asked.groupBy("token", "group").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most_rest"), F.min("component").alias("low"), F.max("component").alias("high")))
    asking = asked.filter("component != largest").select("token", "class", "n", "component", "rest")
    fits = (PERCENT * F.col("n") <= 100 * F.col("most_n")) & (PERCENT * F.col("least_n") <= 100 * F.col("n"))
    # at the first token that two sets share, what is left of both bounds their overlap
    needed = PERCENT * (F.col("n") + F.col("least_n"))
    fits = fits & ((100 + PERCENT) * F.col("rest") >= needed) & ((100 + PERCENT) * F.col("most_rest") >= needed)
    apart = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    candidates = settled(asking.join(matrix, "token").filter(fits & apart).select("class", "group").distinct())

    sets = linked.select("class", "tokens")
    opened = candidates.select("group").distinct()
    member = F.struct("rep", "n", "component", "probes", "tokens")
    members = placed.join(opened, "group", "left_semi").join(sets, "class").groupBy("group").agg(F.collect_list(member).alias("members"))  # about GROUP_SETS
    groups = settled(members.withColumn("union", F.array_distinct(F.flatten("members.tokens"))))
    query = placed.select("class", "rep", "n", "component", "probes").join(sets, "class")
    bounded = candidates.join(query, "class").join(groups, "group")
    bounded = bounded.filter(100 * F.size(F.array_intersect("tokens", "union")) >= PERCENT * F.col("n"))

    def links_with(m):
        # two sets that are alike share a prefix token, so only such members are compared in full
        near = (m["component"] != F.col("component")) & _may_be_alike(F.col("n"), m["n"]) & F.arrays_overlap(m["probes"], F.col("probes"))
        return near & _alike(F.size(F.array_intersect(F.col("tokens"), m["tokens"])), F.col("n"), m["n"])

    found = bounded.select(F.col("rep").alias("a"), F.explode(F.transform(F.filter("members", links_with), lambda m: m["rep"])).alias("b"))
    return settled(found.distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row; class_id is the smallest doc_id with an equal set."""
    rows = settled(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_profile_batches, "doc_id long, n long, class binary"))
    classes = settled(rows.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))
    linked = linked_classes(docs, classes)
    stars = star_links(linked)
    links = settled(stars.union(matrix_links(linked, connected_components(stars))).distinct())

    member = settled(rows.join(classes, "class", "left"))
    # rows of one doc_id with different texts are one vertex: each row's class and its doc_id are linked
    repeated = member.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b")
    same = member.join(repeated.select("doc_id"), "doc_id", "left_semi").filter("rep is not null and doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.union(same))
    out = member.withColumn("vertex", F.coalesce("rep", "doc_id")).join(components, F.col("vertex") == components["id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "vertex"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("rep").alias("class_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: the smallest doc_id; rows without doc_id stay."""
    name = free_name(docs, "gone")
    gone = jaccard_components(docs).filter("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id,
       CASE WHEN len(s.s) > 0 THEN min(s.doc_id) OVER (PARTITION BY s.s) END AS class_id
FROM sets s LEFT JOIN reached r ON r.x = s.doc_id
GROUP BY s.doc_id, s.s
"""

"""Phrase collocations by depth-first search over compressed position bitmaps.

A shard is what one task reads of one language, up to SHARD_WORDS words; a
longer text is a shard of its own size. In a shard, phrases grow by shift, AND
and popcount (phrase_bitmaps.py); popcounts are summed over shards. Four passes
over the texts: words, pairs of frequent words, longer phrases all of whose pairs
are frequent, each summed under hashed keys; the keys that reach the support go
into a Bloom filter that later passes prune with. The last pass follows only
phrases that the filter lets through and sums them under their own text, so
neither clashing keys nor the filter's false positives reach the result. The
filter has 16 bits a key, 2^FILTER_POWER at most (32 MB): beyond that many keys
it prunes less and the result stays the same.

A shard sends its counts packed, one row for each bucket of keys; a bucket is
merged in one Arrow call. Buckets are hashed and there is one for each
BUCKET_BYTES of text, up to 2^20.

A candidate's parts are frequent themselves, so their counts are joined from the
same table. A longer phrase with the same count goes through phrases of every
length between, so a candidate is dropped by looking one word further only.

Defined results: a null lang is `und`, a null or empty text has no words. A row
without doc_id counts as any other; repeated rows count as often as they occur.
Texts of any length are read whole. Equal scores rank by count, then by the
phrase's UTF-8 bytes. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.frames import documents, settled, volume
from dossier.llm.key_filter import FILTER_POWER, KeySet, bucket_of, key_set, spread
from dossier.llm.phrase_bitmaps import LOWER, Level, Shard, first_key, piece_words, word_hashes
from dossier.llm.words import U64, slices, texts_of

SUPPORT = 100
LONGEST = 5
TOP = 2000
SHARD_WORDS = 1 << 20
#: The first cut of a language's ranking; each part hands on TOP rows at most.
RANK_PARTS = 64
#: Text whose phrases share a bucket, and the most buckets as a power of two.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 20
PACKED = "bucket int, keys binary, counts binary"
SPELT = "lang string, bucket int, phrases array<string>, counts array<long>"
PHRASES = "lang string, phrase string, len int, a long"


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """Words of one language in one task, as they come."""

    def __init__(self):
        self.hashes, self.begins, self.n, self.spelt = [], [], 0, {}

    def add(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, begins: np.ndarray, spell: KeySet | None, lang: int) -> None:
        self.hashes.append(hashes)
        self.begins.append(begins)
        self.n += len(hashes)
        if spell is not None:
            found, at = np.unique(hashes, return_index=True)
            use = spell.has(first_key(found, lang))
            for h, i in zip(found[use].tolist(), at[use].tolist(), strict=True):
                if h not in self.spelt:
                    self.spelt[h] = raw[start[i] : end[i]].tobytes().decode()

    def shard(self, lang: int, frequent: KeySet | None) -> Shard:
        return Shard(np.concatenate(self.hashes), np.concatenate(self.begins), lang, frequent)


def read_words(batches: Iterator[pa.RecordBatch], spell: KeySet | None, most: int) -> Iterator[tuple[str, Words]]:
    """(language, its words) whenever a language has `most` words or the task ends."""
    held: dict[str, Words] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        raw_all, at = texts_of(batch.column(1))
        for lo, hi in slices(at):
            raw = LOWER[raw_all[at[lo] : at[hi]]]
            start, end, row, begins = piece_words(raw, at[lo : hi + 1] - at[lo])
            hashes, spoken = word_hashes(raw, start, end), code[lo:hi][row]
            for c in np.unique(spoken):
                name, mine = names[c], np.flatnonzero(spoken == c)
                held.setdefault(name, Words()).add(raw, start[mine], end[mine], hashes[mine], begins[mine], spell, lang_key(name))
                if held[name].n >= most:
                    yield name, held.pop(name)
        while sum(w.n for w in held.values()) > 2 * most:  # many languages in one task
            name = max(held, key=lambda x: held[x].n)
            yield name, held.pop(name)
    yield from held.items()


def _by_bucket(keys: np.ndarray, power: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys)."""
    if not len(keys):
        return
    bucket = bucket_of(keys, power)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
    for lo, hi in zip(edges, np.append(edges[1:], len(keys)), strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _packed(keys: np.ndarray, counts: np.ndarray, power: int) -> pa.RecordBatch:
    rows = [(b, (keys[at] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), counts[at].astype(np.uint32).tobytes()) for b, at in _by_bucket(keys, power)]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "counts"])


def _count_words(power: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words in read_words(batches, None, most):
            shard = words.shard(lang_key(name), None)
            yield _packed(shard.key, shard.n, power)

    return run


def _count_phrases(shared, lengths: tuple[int, ...], power: int, most: int):
    """Popcounts of each shard's phrases of these lengths, all of whose words and (beyond two words) pairs are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for name, words in read_words(batches, None, most):
            shard, keys, counts = words.shard(lang_key(name), known), [np.zeros(0, U64)], [np.zeros(0, np.int64)]

            def wanted(length: int, new: Level, old: Level) -> np.ndarray:
                if length == 1 or length in lengths and length == 2:
                    return np.ones(len(new.key), bool)
                return known.has(shard.pair_keys(old.last[new.parent], new.last))

            def seen(length: int, new: Level) -> None:
                if length in lengths:
                    keys.append(new.key)
                    counts.append(new.count)

            shard.follow(max(lengths), wanted, seen)
            yield _packed(np.concatenate(keys), np.concatenate(counts), power)

    return run


def _spell_phrases(shared, longest: int, power: int, most: int):
    """Texts and popcounts of each shard's phrases in the filter, one row a bucket; the number of its words under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for name, words in read_words(batches, known, most):
            shard = words.shard(lang_key(name), known)
            spelt = [words.spelt.get(h) for h in shard.words.tolist()]
            open_texts, texts, keys, counts = {}, [""], [np.zeros(1, U64)], [np.array([shard.size])]

            def wanted(length: int, new: Level, old: Level) -> np.ndarray:
                return known.has(new.key)

            def seen(length: int, new: Level) -> None:
                last = [spelt[w] for w in new.last.tolist()]
                open_texts[length] = last if length == 1 else [f"{open_texts[length - 1][p]} {w}" for p, w in zip(new.parent.tolist(), last, strict=True)]
                texts.extend(open_texts[length])
                keys.append(new.key)
                counts.append(new.count)

            shard.follow(longest, wanted, seen)
            phrases, n, rows = pa.array(texts, pa.string()), np.concatenate(counts), [*_by_bucket(np.concatenate(keys), power)]
            columns = [pa.array([name] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), _lists(phrases, rows), _lists(pa.array(n, pa.int64()), rows)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "phrases", "counts"])

    return run


def _lists(values: pa.Array, rows: list[tuple[int, np.ndarray]]) -> pa.ListArray:
    edges = np.cumsum([0, *(len(at) for _, at in rows)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values.take(pa.array(np.concatenate([at for _, at in rows]))))


def _merge_keys(support: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table[c]]) for c in ("keys", "counts"))
        order = np.argsort(keys)
        edges = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0))
        found = keys[order[edges]][np.add.reduceat(counts[order], edges, dtype=np.int64) >= support]
        return pa.table({"key": pa.array(spread(np.full(len(found), table["bucket"][0].as_py()), found).view(np.int64))})

    return run


def _merge_phrases(support: int):
    def run(table: pa.Table) -> pa.Table:
        flat = pa.table({c: table[c].combine_chunks().flatten() if table[c].num_chunks < 2 else pa.concat_arrays([x.flatten() for x in table[c].chunks]) for c in ("phrases", "counts")})
        total = flat.group_by("phrases").aggregate([("counts", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total["counts_sum"], support), pc.equal(total["phrases"], "")))
        words = pc.if_else(pc.equal(total["phrases"], ""), 0, pc.add(pc.count_substring(total["phrases"], " "), 1)).cast(pa.int32())
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * total.num_rows, pa.string()), "phrase": total["phrases"], "len": words, "a": total["counts_sum"]})

    return run


def frequent_keys(packed: DataFrame, support: int) -> DataFrame:
    return settled(packed.groupBy("bucket").applyInArrow(_merge_keys(support), "key long"))


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_words: int = SHARD_WORDS, power: int = FILTER_POWER) -> DataFrame:
    """(lang, phrase, len, a): exact counts of all phrases of `support` occurrences or more; len 0 has a language's words."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    buckets = min(MOST_BUCKETS, (volume(rows)[1] // BUCKET_BYTES).bit_length())
    keys = frequent_keys(rows.mapInArrow(_count_words(buckets, shard_words), PACKED), support)
    for lengths in ((2,), tuple(range(3, longest + 1))):
        if lengths and max(lengths) <= longest:
            shared = context.broadcast(key_set(keys, buckets, power))
            keys = keys.unionByName(frequent_keys(rows.mapInArrow(_count_phrases(shared, lengths, buckets, shard_words), PACKED), support))
    shared = context.broadcast(key_set(keys, buckets, power))
    spelt = rows.mapInArrow(_spell_phrases(shared, longest, buckets, shard_words), SPELT)
    return spelt.groupBy("lang", "bucket").applyInArrow(_merge_phrases(support), PHRASES)


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in integers of 38 digits."""
    wide = lambda x: x.cast("decimal(38,0)")
    above, below = wide(wide(F.lit(1000) * a.cast("decimal(19,0)")) * n.cast("decimal(19,0)")), wide(left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS, power: int = FILTER_POWER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    counts = settled(phrase_counts(docs, support, longest, shard_words, power))
    totals = counts.filter("len = 0").select("lang", F.col("a").alias("n"))
    phrases = counts.filter("len > 1")
    known = counts.filter("len > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("n_part"))

    inner = phrases.filter("len > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', len - 1)"), F.expr("substring_index(phrase, ' ', 1 - len)"))).alias("phrase"))
    kept = phrases.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, len - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - len)")})
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("n_part").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("n_part").alias("r")), ["lang", "rest"])
    # one row a language, as many as there are languages: settled on its own, joined by shuffle if large
    cuts = cuts.join(totals, "lang")
    score = exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = rf"""
WITH pieces AS (
  SELECT lang, rid, generate_subscripts(ps, 1) AS piece, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
               regexp_split_to_array(translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_LOWER}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
words AS (SELECT lang, rid, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS p FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4, lead(w1, 4) OVER q AS w5
  FROM words WINDOW q AS (PARTITION BY lang, rid, piece ORDER BY p)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
phrases AS (
  {" UNION ALL ".join(f"SELECT lang, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS phrase, {k} AS len, count(*) AS a FROM runs WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= {SUPPORT}" for k in range(1, LONGEST + 1))}),
kept AS (
  SELECT * FROM phrases p WHERE len > 1 AND NOT EXISTS (
    SELECT 1 FROM phrases q WHERE q.lang = p.lang AND q.len > p.len AND q.a >= p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, len, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = c.head JOIN phrases y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""

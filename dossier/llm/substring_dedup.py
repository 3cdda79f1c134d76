"""Substring dedup with fixed-block anchors.

Index: the non-overlapping BLOCK-word blocks of every document. Probes: every
rolling BLOCK-word window of every document. BLOCK is half of WINDOW, so each
WINDOW-word run holds a whole block wherever it begins. Index entries and probes
meet in hash buckets. A probe that meets a block of another document is a hit;
hits grow left and right while the rolling windows are shared with another
document. Inside the grown runs, WINDOW-word digests (96 bits) meet once more to
settle which document holds each sequence first, and runs of settled windows
join to maximal exact repeats.

Documents are hashed to batches. A batch sends its hashes sorted and packed, and
the answer is bits in the same order, so a hash costs 4 bytes, an answer 2 bits,
and no hit is ever a row of its own. A batch names a hash once however often it
occurs, so a passage in every document costs a bucket one entry a batch.
Batches and buckets grow with the square root of the input.

Defined results: a null text has no words; texts below WINDOW words lose none.
Rows with a null doc_id count as later than all others. Rows that repeat a
doc_id are not smaller than each other and take nothing from each other. Texts
of any length are read whole, each in one batch. Extra columns are not read; an
empty table gives an empty result. Rows are dealt to
batches by doc_id and place, so docs must be a table or checkpoint that every
job reads alike; answers that don't fit their batch raise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents, volume
from dossier.llm.words import mix, slices, span_hashes, spans, texts_of, window_hashes

WINDOW = 50
BLOCK = 25
KEY_BITS = 30
LAST = np.iinfo(np.int64).max


class _Batch:
    """Word hashes and windows of one batch, documents in order of doc_id."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].combine_chunks()
        doc_id = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(doc_id, kind="stable")
        self.table = table.take(pa.array(order))
        self.doc_id = doc_id[order]
        self.raw, self.offsets = texts_of(self.table["text"])
        hashes, starts, ends, rows = [], [], [], []
        for lo, hi in slices(self.offsets):
            begin = self.offsets[lo]
            raw, offsets = self.raw[begin : self.offsets[hi]], self.offsets[lo : hi + 1] - begin
            s, e, r = spans(raw, offsets)
            hashes.append(span_hashes(raw, s, e, seed=11))
            starts.append(s + begin)
            ends.append(e + begin)
            rows.append(r + lo)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.words, self.start, self.end, self.row = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64), join(rows, np.int64)
        self.edges = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.edges)

    def windows(self, size: int) -> np.ndarray:
        """Starts of whole windows of documents with WINDOW words or more."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.row[:n] == self.row[size - 1 :]) & (self.n_words[self.row[:n]] >= WINDOW))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, in two documents or more, at an index block, starts, hash number of each start)."""
        at = self.windows(BLOCK)
        keys = window_hashes(self.words, BLOCK, seed=12)[at]
        order = np.argsort(keys, kind="stable")
        k, row = keys[order], self.row[at][order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        number = np.zeros(len(k), np.int64)
        number[order] = group
        head = np.flatnonzero(new)
        blocks = ((at - self.edges[self.row[at]]) % BLOCK == 0)[order]
        if not len(head):
            return k, np.zeros(0, bool), np.zeros(0, bool), at, number
        ids = self.doc_id[row]  # rows of one doc_id are one document
        return k[head], np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head), np.logical_or.reduceat(blocks, head), at, number

    def candidates(self, shared: np.ndarray, hit: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Starts of WINDOW-word windows in runs that grew from a hit."""
        marks = np.zeros((2, len(self.words) + 1), np.int64)
        marks[0, at + 1], marks[1, at + 1] = shared[number], hit[number]
        np.cumsum(marks, axis=1, out=marks)
        begin = self.windows(WINDOW)
        reach = WINDOW - BLOCK + 1
        return begin[(marks[0, begin + reach] - marks[0, begin] == reach) & (marks[1, begin + reach] > marks[1, begin])]

    def digests(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, more digest, first document's row) of distinct windows; the number of each window."""
        high = window_hashes(self.words, WINDOW, seed=13)[begin]
        low = (window_hashes(mix(self.words ^ np.uint64(0x6A09E667F3BCC909)), WINDOW, seed=14)[begin] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        number = np.zeros(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return h[new], w[new], self.row[begin][order][new], number


def _cut(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, lo, hi) of the runs of sorted hashes with equal top bits."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    if not len(bucket):
        return
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(head, np.append(head[1:], len(bucket)), strict=True):
        yield int(bucket[lo]), int(lo), int(hi)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _sent(bucket: list[int], batch: int, packed: list[bytes]) -> pa.Table:
    return _rows({"bucket": (bucket, pa.int32()), "batch": ([batch] * len(bucket), pa.int32()), "packed": (packed, pa.binary())})


SENT = "bucket int, batch int, packed binary"
ANSWER = "kind int, batch int, bucket int, n int, bits binary"


def _send_probes(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hashes, several, block, _, _ = _Batch(table).probes()
        code = ((hashes >> np.uint64(64 - bits - KEY_BITS)) & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32) << np.uint32(2)
        code |= several.astype(np.uint32) << np.uint32(1) | block.astype(np.uint32)
        cuts = [*_cut(hashes, bits)]
        return _sent([c[0] for c in cuts], key[0].as_py(), [code[lo:hi].tobytes() for _, lo, hi in cuts])

    return run


def _answers(kind: int, table: pa.Table, sizes: list[int], flags: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum(sizes)
    packed = [b"".join(np.packbits(f[e - n : e]).tobytes() for f in flags) for n, e in zip(sizes, ends, strict=True)]
    n = len(sizes)
    return _rows({"kind": ([kind] * n, pa.int32()), "batch": (table["batch"].to_pylist(), pa.int32()), "bucket": (table["bucket"].to_pylist(), pa.int32()), "n": (sizes, pa.int32()), "bits": (packed, pa.binary())})


def _match_blocks(table: pa.Table) -> pa.Table:
    """Bits: the window occurs in two documents; and one of them has it as an index block."""
    parts = [np.frombuffer(x, np.uint32) for x in table["packed"].to_pylist()]
    code = np.concatenate(parts)
    order = np.argsort(code >> np.uint32(2), kind="stable")
    key = code[order] >> np.uint32(2)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    runs = np.diff(np.append(head, len(key)))
    several = (runs > 1) | np.logical_or.reduceat((code[order] & 2) > 0, head)
    hit = several & np.logical_or.reduceat((code[order] & 1) > 0, head)
    out = np.zeros((2, len(code)), bool)
    out[0, order], out[1, order] = np.repeat(several, runs), np.repeat(hit, runs)
    return _answers(1, table, [len(p) for p in parts], [out[0], out[1]])


def _told(answers: pa.Table, kind: int, expected: int, flags: int) -> list[np.ndarray]:
    """Flags of a batch's own hashes, in their order."""
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    if sum(r["n"] for r in rows) != expected:
        raise RuntimeError("answers do not fit the batch that asked")
    out = [[] for _ in range(flags)]
    for r in rows:
        size = (r["n"] + 7) // 8
        for f in range(flags):
            out[f].append(np.unpackbits(np.frombuffer(r["bits"], np.uint8, size, f * size), count=r["n"]).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]


def _send_windows(bits: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([], 0, [])
        batch = _Batch(table)
        hashes, _, _, at, number = batch.probes()
        shared, hit = _told(answers, 1, len(hashes), 2)
        high, low, row, _ = batch.digests(batch.candidates(shared, hit, at, number))
        buckets, packed = [], []
        for bucket, lo, hi in _cut(high, bits):
            ids, local = np.unique(batch.doc_id[row[lo:hi]], return_inverse=True)
            buckets.append(bucket)
            packed.append(np.uint32(hi - lo).tobytes() + high[lo:hi].tobytes() + low[lo:hi].tobytes() + local.astype(np.uint32).tobytes() + ids.tobytes())
        return _sent(buckets, key[0].as_py(), packed)

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """Bit: a smaller document has the window, too."""
    sizes, high, low, doc = [], [], [], []
    for x in table["packed"].to_pylist():
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        sizes.append(n)
        high.append(np.frombuffer(x, np.uint64, n, 4))
        low.append(np.frombuffer(x, np.uint32, n, 4 + 8 * n))
        doc.append(np.frombuffer(x, np.int64, -1, 4 + 16 * n)[np.frombuffer(x, np.uint32, n, 4 + 12 * n)])
    high, low, doc = np.concatenate(high), np.concatenate(low), np.concatenate(doc)
    order = np.lexsort((low, high))
    h, w, d = high[order], low[order], doc[order]
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(h))))
    earlier = np.zeros(len(h), bool)
    earlier[order] = least < d
    return _answers(2, table, sizes, [earlier])


def _removed(batch: _Batch, answers: pa.Table) -> np.ndarray:
    """Whether each word of the batch lies in a window that an earlier document has."""
    hashes, _, _, at, number = batch.probes()
    shared, hit = _told(answers, 1, len(hashes), 2)
    begin = batch.candidates(shared, hit, at, number)
    _, _, first, window = batch.digests(begin)
    (earlier,) = _told(answers, 2, len(first), 1)
    gone = begin[earlier[window] | (batch.doc_id[batch.row[begin]] > batch.doc_id[first[window]])]
    cover = np.zeros(len(batch.words) + WINDOW + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + WINDOW, -1)
    return np.cumsum(cover)[: len(batch.words)] > 0


def _cut_text(text: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without its removed words and the white space after each."""
    if not len(start) or not gone.any():
        return text
    out, keep = [text[: start[0]]], np.append(start[1:], len(text))
    for i in np.flatnonzero(~gone):
        out.append(text[start[i] : keep[i]])
    return b"".join(out)


def _finish(with_text: bool):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(table)
        gone = _removed(batch, answers)
        blob, digests, texts, removed = batch.raw.tobytes(), [], [], []
        there = batch.table["text"].is_valid().to_pylist()
        for i in range(len(batch.doc_id)):
            lo, hi = batch.edges[i], batch.edges[i + 1]
            text, out = blob[batch.offsets[i] : batch.offsets[i + 1]], gone[lo:hi]
            removed.append(int(out.sum()))
            words = text.split()
            digests.append(hashlib.sha256(b" ".join(compress(words, ~out) if removed[-1] else words)).hexdigest())
            if with_text:
                kept = _cut_text(text, batch.start[lo:hi] - batch.offsets[i], batch.end[lo:hi] - batch.offsets[i], out)
                texts.append(kept.decode() if there[i] else None)
        columns = {"n_words": pa.array(batch.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            columns |= {"kept_text": pa.array(texts, pa.string()), "rest": batch.table["rest"]}
        return pa.table({"doc_id": batch.table["doc_id"], **columns})

    return run


def plan_sizes(total_bytes: int) -> tuple[int, int]:
    """(batches, bucket bits).

    Batches are 6 MB for small inputs and grow to 64 MB. A bucket has about 2^17
    windows as long as a batch sends it 64 or more; from there on buckets grow to
    2^24 windows (64 MB packed), and then a batch sends fewer to each.
    """
    batch_bytes = min(64 << 20, max(6 << 20, int(6e6 * math.sqrt(total_bytes / 64e9))))
    windows = total_bytes / 6
    buckets = max(min(windows / (1 << 17), batch_bytes / 6 / 64), windows / (1 << 24))
    return max(64, math.ceil(total_bytes / batch_bytes)), max(8, math.ceil(math.log2(max(1, buckets))))


def _swept(docs: DataFrame, with_text: bool) -> DataFrame:
    batches, bits = plan_sizes(volume(docs)[1])
    # by the place of a row in the table, so that rows which repeat are dealt out as well
    batch = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(batches)).cast("int").alias("batch")
    rest = F.struct(F.lit(None).cast("int").alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("rest")
    rows = docs.select(batch, F.col("doc_id").cast("long").alias("doc_id"), "text", *[rest] * with_text)
    by_batch = rows.groupBy("batch")
    blocks = by_batch.applyInArrow(_send_probes(bits), SENT).groupBy("bucket").applyInArrow(_match_blocks, ANSWER)
    windows = by_batch.cogroup(blocks.groupBy("batch")).applyInArrow(_send_windows(bits), SENT).groupBy("bucket").applyInArrow(_match_windows, ANSWER)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += f", kept_text string, rest {rows.schema['rest'].dataType.simpleString()}"
    return by_batch.cogroup(blocks.union(windows).groupBy("batch")).applyInArrow(_finish(with_text), schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    return _swept(docs, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without the words that substring_dedup removes.

    The other white space of a text stays; n_chars, where there is one, follows
    the new text. A row that loses all its words goes; one that had none stays.
    """
    done = _swept(docs, True).filter("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return done.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
repeated AS (
  SELECT v.doc_id, v.i FROM windows v JOIN (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h) f ON v.h = f.h AND f.first_id < v.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(50) AS t(k)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Texts are encoded and cut into pieces on the map side; only lengths and CRCs go
on. The driver packs the histogram of lengths (CAPACITY counts, whatever the
corpus) by bin completion; its patterns become ranges of ranks within each
length. Pieces of a length are ranked in salted parts with exact offsets, and a
search in the broadcast ranges gives each piece its sequence and place.

Defined results: null and empty texts are one separator token; rows without
doc_id are packed as any other. Texts of any length are cut into as many pieces
as they need, and pieces of equal length may change places. Repeated rows are
packed each on their own; which of several pieces of one length lies where
follows the order in which they were written, not their doc_id. Extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.bin_completion import pack
from dossier.llm.frames import documents, settled
from dossier.llm.pieces import distinct_chunks, gather
from dossier.llm.token_counts import tokenizer_path
from dossier.llm.word_runs import word_runs
from dossier.llm.words import slices, texts_of

CAPACITY = 2048
SEPARATOR = 0
SLICE = 2 << 20
PART_ROWS = 2000
_RANK_BITS = 44


def _piece_batches(path: str, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_runs(path)
        for batch in batches:
            raw_all, at = texts_of(batch.column(1))
            source, piece, begin, length, crc = [], [], [], [], []
            for lo, hi in slices(at, SLICE):
                raw, start, end = tokenizer.chunks(raw_all[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                rows = hi - lo
                codes, chunks = distinct_chunks(raw, start, end)
                flat, edges = tokenizer.encoder(chunks)
                # one more chunk, the separator, after the last of each text
                last = np.searchsorted(start, at[lo + 1 : hi + 1] - at[lo])
                codes = np.insert(codes.astype(np.int64), last, len(edges) - 1)
                ids, ends = gather(np.append(flat, np.uint32(SEPARATOR)), np.append(edges, edges[-1] + 1), codes)
                text_ends = ends[last + np.arange(rows)]
                n = np.diff(text_ends, prepend=0)
                pieces = -(-n // cap)
                of = np.repeat(np.arange(rows), pieces)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(cap, n[of] - nth * cap)
                past = text_ends[of] - n[of] + nth * cap + size
                view = memoryview(ids.astype("<u4").tobytes())
                crc.append(np.array([zlib.crc32(view[4 * (p - k) : 4 * p]) for p, k in zip(past.tolist(), size.tolist(), strict=True)], np.int64))
                source.append(of + lo)
                piece.append(nth)
                begin.append(nth * cap)
                length.append(size)
            join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            columns = [join(piece, pa.int32()), *(join(x, pa.int64()) for x in (begin, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(join(source, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def rank_ranges(counts: np.ndarray, cap: int) -> dict[str, np.ndarray]:
    """For each range of ranks of a length: its key, first sequence, copies in a sequence, offset of the first copy."""
    ranges, used, sequence = [], np.zeros(len(counts), np.int64), 0
    for content, times in pack(counts, cap):
        offset = 0
        for size, copies in content:
            ranges.append((size, int(used[size]), sequence, copies, offset))
            used[size] += times * copies
            offset += size * copies
        sequence += times
    ranges.sort()
    columns = np.array(ranges, np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << _RANK_BITS) + columns[1], "rank": columns[1], "sequence": columns[2], "copies": columns[3], "offset": columns[4]}


def _place_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(table["key"], (length << _RANK_BITS) + rank, "right") - 1
            nth = rank - table["rank"][at]
            copies = table["copies"][at]
            columns = [*batch.columns[:5], pa.array(table["sequence"][at] + nth // copies), pa.array(table["offset"][at] + nth % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, tokenizer: str, cap: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(tokenizer, cap), schema)
    pieces = settled(pieces.withColumn("row", F.monotonically_increasing_id()))  # written once: the numbers stay
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # cap rows at most
    counts = np.zeros(cap + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    parts = F.array(*(F.lit(max(1, -(-int(n) // PART_ROWS))) for n in counts))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.element_at(parts, F.col("length").cast("int") + 1)).cast("int"))
    # a row for PART_ROWS pieces, and one for each length
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    ranked = dealt.withColumn("inner", inner).join(offsets, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inner") + F.col("before")).cast("long").alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(rank_ranges(counts, cap))
    return ranked.mapInArrow(_place_batches(shared), f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))

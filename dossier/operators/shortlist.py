"""Two-channel shortlists: every document against all of a small list of activities.

The small side becomes one scoring matrix: for the keyword channel the BM25
weight of each token in each activity, for the vector channel unit vectors, with
phases and systems beside them. It is broadcast; its size is checked against
MATRIX_BYTES before anything is collected. Documents stream past it in Arrow
batches where they lie, so there is no shuffle, and no document reaches the
driver. Both channels rank all activities; a document that shares no word with
any, or has no vector, still gets its shortlist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.vocabulary import PHASE_BUCKETS
from dossier.operators.retrieval import RRF_K, B, K1, token_spans

#: Text and vectors of all activities; those of a whole construction schedule are some 20 MB.
MATRIX_BYTES = 256 << 20
#: Scores that one slice of a batch may hold for each channel.
CELLS = 1 << 20
SHORTLIST = "query_id long, source string, activity_id long, a_score double, b_score double, a_rank int, b_rank int, rrf double, rank int"


@dataclass
class ActivityMatrix:
    """All activities in order of their id; postings of token i are activity[begin[i]:begin[i + 1]]."""

    ids: np.ndarray
    tokens: list[bytes]
    begin: np.ndarray
    activity: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    phases: list[str]
    systems: list[set[str]] = field(default_factory=list)

    @classmethod
    def of(cls, activities: DataFrame) -> ActivityMatrix:
        """From (activity_id, text, vector or null, phase, systems); beyond MATRIX_BYTES it is refused."""
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) + 64
        held = activities.agg(F.sum(size)).first()[0] or 0
        if held > MATRIX_BYTES:
            raise ValueError(f"activities take {held} bytes; a scoring matrix holds {MATRIX_BYTES}")
        rows = activities.select(F.col("activity_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), "vector", F.coalesce("phase", F.lit("")).alias("phase"), "systems").orderBy("activity_id").toArrow()
        texts = rows["text"].combine_chunks().cast(pa.large_binary())
        token, row, length = _tokens(texts)
        tokens, code = np.unique(np.array(token, object), return_inverse=True) if len(token) else (np.zeros(0, object), np.zeros(0, np.int64))
        posting, tf = np.unique(code * max(1, len(texts)) + row, return_counts=True)
        word, activity = np.divmod(posting, max(1, len(texts)))
        df = np.bincount(word, minlength=len(tokens))
        idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        average = max(1.0, float(length.mean())) if len(length) else 1.0
        weight = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[activity] / average))
        found = rows["vector"].to_pylist()
        vectors = np.zeros((len(found), max((len(v) for v in found if v), default=1)))
        for i, v in enumerate(found):
            if v:
                vectors[i] = _unit(v)
        return cls(rows["activity_id"].to_numpy(), tokens.tolist(), np.append(0, np.cumsum(df)), activity, weight, vectors, rows["phase"].to_pylist(), [set(s or ()) for s in rows["systems"].to_pylist()])

    def keyword_scores(self, texts: pa.Array) -> np.ndarray:
        """texts x activities; a repeated token of a text counts repeatedly."""
        n = len(self.ids)
        token, row, _ = _tokens(texts)
        code = pc.index_in(token, value_set=pa.array(self.tokens, pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(token) else np.zeros(0, np.int64)
        asked, qtf = np.unique(row[code >= 0] * max(1, len(self.tokens)) + code[code >= 0], return_counts=True)
        row, code = np.divmod(asked, max(1, len(self.tokens)))
        df = self.begin[code + 1] - self.begin[code]
        each = np.repeat(self.begin[code] - (np.cumsum(df) - df), df) + np.arange(int(df.sum()))
        place = np.repeat(row, df) * n + self.activity[each]
        return np.round(np.bincount(place, np.repeat(qtf, df) * self.weight[each], minlength=len(texts) * n).reshape(len(texts), n), 6)

    def vector_scores(self, vectors: list) -> np.ndarray:
        """vectors x activities, cosines; a missing vector scores 0 everywhere."""
        asked = np.stack([_unit(v) if v and len(v) == self.vectors.shape[1] else np.zeros(self.vectors.shape[1]) for v in vectors])
        return np.round(asked @ self.vectors.T, 6)

    def open_phases(self, phases: list) -> np.ndarray:
        """Which activities the bucket of each query phase lets in; all where it has none or none is in it."""
        known = {p: np.isin(self.phases, PHASE_BUCKETS[p]) for p in {*phases} if p in PHASE_BUCKETS}
        everything = np.ones(len(self.ids), bool)
        return np.stack([known[p] if p in known and known[p].any() else everything for p in phases])

    def cells(self, systems: list, phases: list) -> np.ndarray:
        """Which activities share a system and a phase with each query."""
        of_system, of_phase = {}, {}
        nothing = np.zeros(len(self.ids), bool)

        def member(keys, known: dict, test) -> np.ndarray:
            out = nothing.copy()
            for key in keys or ():
                if key not in known:
                    known[key] = np.fromiter((test(i, key) for i in range(len(self.ids))), bool, len(self.ids))
                out |= known[key]
            return out

        return np.stack([member(s, of_system, lambda i, k: k in self.systems[i]) & member(p, of_phase, lambda i, k: k == self.phases[i]) for s, p in zip(systems, phases, strict=True)])


def _unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tokens, the text of each, tokens of each text); texts are lower-cased bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
    start, end, row = token_spans(raw, at - at[0])
    ends = np.cumsum(end - start)
    packed = raw[np.repeat(start - (ends - (end - start)), end - start) + np.arange(ends[-1] if len(ends) else 0)]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    return words, row, np.bincount(row, minlength=len(texts))


def _places(order: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Place of each activity in its row's order among the members; those outside come after all."""
    inside = np.take_along_axis(member, order, 1)
    nth = np.where(inside, np.cumsum(inside, axis=1), np.iinfo(np.int64).max)
    out = np.empty_like(nth)
    np.put_along_axis(out, order, nth, 1)
    return out


def _fused(a_rank: np.ndarray, b_rank: np.ndarray, candidate: np.ndarray, top: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, activity, rrf, rank) of each row's best candidates; ties by activity."""
    row, activity = np.nonzero(candidate)
    rrf = np.round(1.0 / (k + a_rank[row, activity]) + 1.0 / (k + b_rank[row, activity]), 9)
    order = np.lexsort((activity, -rrf, row))
    row, activity, rrf = row[order], activity[order], rrf[order]
    n = np.bincount(row, minlength=len(candidate))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
    return row[rank <= top], activity[rank <= top], rrf[rank <= top], rank[rank <= top]


def shortlist_slice(matrix: ActivityMatrix, ids: list, texts: pa.Array, vectors: list, phases: list, systems: list, cell_phases: list, retrieve: int, top: int, k: int = RRF_K) -> pa.RecordBatch:
    """Both shortlists of some documents.

    `text`: activities of the open phases, the `retrieve` best of either channel,
    fused by their ranks among all activities. `cell`: those of the document's
    systems and phases, fused by their ranks in the cell.
    """
    a, b = matrix.keyword_scores(texts), matrix.vector_scores(vectors)
    orders = [np.argsort(-x, axis=1, kind="stable") for x in (a, b)]
    everything = np.ones(a.shape, bool)
    ranks = [_places(o, everything) for o in orders]
    open_to = matrix.open_phases(phases)
    wanted = np.logical_or(*[_places(o, open_to) <= retrieve for o in orders])
    cell = matrix.cells(systems, cell_phases)
    own = [_places(o, cell) for o in orders]
    parts = []
    for source, (a_rank, b_rank), candidate in (("text", ranks, wanted), ("cell", own, cell)):
        row, activity, rrf, rank = _fused(a_rank, b_rank, candidate, top, k)
        at = (row, activity)
        parts.append((np.asarray(ids)[row], np.full(len(row), source, object), matrix.ids[activity], a[at], b[at], a_rank[at], b_rank[at], rrf, rank))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts, strict=True), kinds, strict=True)], [c.split()[0] for c in SHORTLIST.split(", ")])


def two_channel_shortlist(queries: DataFrame, activities: DataFrame, retrieve: int, top: int) -> DataFrame:
    """(query_id, source, activity_id, scores, ranks, rrf, rank): for each query its shortlist by text and that of its cell.

    queries: query_id, text, vector, phase, systems, cell_phases; activities:
    activity_id, text, vector, phase, systems. Null texts have no words, null
    vectors score 0; a query without systems or cell phases has no cell rows.
    """
    shared = queries.sparkSession.sparkContext.broadcast(ActivityMatrix.of(activities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        rows = max(1, CELLS // max(1, len(matrix.ids)))
        for whole in batches:
            for lo in range(0, whole.num_rows if len(matrix.ids) else 0, rows):
                batch = whole.slice(lo, rows)
                texts = batch.column(1).cast(pa.large_binary())
                yield shortlist_slice(matrix, batch.column(0).to_pylist(), texts, *[batch.column(i).to_pylist() for i in range(2, 6)], retrieve, top)

    text = F.lower(F.coalesce("text", F.lit("")))
    asked = queries.select(F.col("query_id").cast("long"), text.alias("text"), F.col("vector").cast("array<double>"), F.coalesce("phase", F.lit("")).alias("phase"), "systems", "cell_phases")
    return asked.mapInArrow(run, SHORTLIST)

"""Keyword and vector retrieval, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import ranked
from dossier.functions.text import word_tokens
from dossier.functions.vocabulary import PHASE_BUCKETS

K1, B = 1.5, 0.75
RRF_K = 60
BLOCK_BYTES = 32 << 20
#: Queries whose tokens travel to the documents; scores that one slice of a batch may hold; what rounding to six digits can move.
QUERY_BLOCK = 2000
SCORE_CELLS = 4_000_000
SCORE_SLACK = 2e-6
#: Scores of vectors that a task holds at a time, for so many rows at most; rows that it hands on at a time; a place without a row; a null id.
VECTOR_CELLS, VECTOR_ROWS, BATCH_ROWS = 1 << 20, 1 << 12, 1 << 16
#: Groups in which the lists of a block's queries are merged; tasks a core among which the corpus of one block is parted.
MERGE_GROUPS, TASKS_A_CORE = 64, 2
UNSET, NO_ID = -4_000_000, np.iinfo(np.int64).min
TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[48:58] = TOKEN_BYTE[97:123] = True


def _asked(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(word_tokens(query)).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of a-z and 0-9 in the bytes of several texts."""
    word = TOKEN_BYTE[raw]
    change = np.zeros(len(raw) + 1, bool)
    change[1:-1] = word[1:] != word[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    inside = word[start] if len(raw) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _kept(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, and of what rounding could still lift among them; equal scores go by id."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        edge = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= edge - SCORE_SLACK]
    order = found[np.lexsort((ids[found], -scores[found]))]
    head = np.flatnonzero(np.append(True, scores[order][1:] != scores[order][:-1])) if len(order) else np.zeros(0, int)
    nth = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[nth < k]


def _coded(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code) of each known token of some lower-cased texts, and the number of all tokens of each text."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
    start, end, row = token_spans(raw, at - at[0])
    ends = np.cumsum(end - start)
    packed = raw[np.repeat(start - (ends - (end - start)), end - start) + np.arange(ends[-1] if len(ends) else 0)]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    code = pc.index_in(words.cast(pa.binary()), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return row[code >= 0], code[code >= 0], np.bincount(row, minlength=len(texts))


def _frequency_batches(tokens: list[str]):
    """Arrow mapper: (doc_id, lower-cased text) to a task's (code, documents with it); code -1 has its documents and their words."""
    known = pa.array([t.encode() for t in tokens], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(len(tokens), np.int64), 0, 0
        for batch in batches:
            row, code, length = _coded(batch.column(1), known)
            df += np.bincount(np.unique(row * max(1, len(tokens)) + code) % max(1, len(tokens)), minlength=len(tokens))
            docs, words = docs + batch.num_rows, words + int(length.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, seen), pa.int32()), pa.array(np.append(docs, df[seen])), pa.array(np.append(words, 0 * seen))], ["code", "n", "words"])

    return run


def _bm25_batches(tokens: list[str], idf: np.ndarray, query: np.ndarray, begin: np.ndarray, qtf: np.ndarray, names: list, average: float, k: int):
    """Arrow mapper: (doc_id, lower-cased text) to the task's best rows of each query. Queries of token i are query[begin[i]:begin[i + 1]]."""
    known = pa.array([t.encode() for t in tokens], pa.binary())

    def score(column: pa.Array) -> np.ndarray:
        row, code, length = _coded(column, known)
        posting, tf = np.unique(row * len(tokens) + code, return_counts=True)
        doc, token = np.divmod(posting, len(tokens))
        weight = idf[token] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length[doc] / average))
        n = begin[token + 1] - begin[token]
        each = np.repeat(begin[token] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = query[each] * len(length) + np.repeat(doc, n)
        return np.bincount(place, np.repeat(weight, n) * qtf[each], minlength=len(names) * len(length)).reshape(len(names), len(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        rows = max(1, SCORE_CELLS // max(1, len(names)))
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                found, ids = score(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                for q in range(len(names)):
                    s, i = np.append(best[q][0], found[q]), np.append(best[q][1], ids)
                    take = _kept(s, i, k)
                    best[q] = (s[take], i[take])
        for q, (s, i) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(s), pa.int64()), pa.array(i), pa.array(s)], ["query_id", "doc_id", "score"])

    return run


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, doc_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; repeated query tokens count repeatedly.

    Up to QUERY_BLOCK queries travel to the documents: one pass counts documents
    of the asked tokens, another scores each document where it lies and hands on
    a task's best rows. More queries than that are joined to the postings of an
    index of the documents, so that neither plan nor driver grows with them.
    """
    if queries.select(query_id).distinct().count() > QUERY_BLOCK:
        from dossier.sources.scratch import scratch_folder
        from dossier.sources.stored import KeywordIndex

        index = KeywordIndex(docs.sparkSession, scratch_folder(docs.sparkSession), doc_id, [text])
        index.append(docs)
        return index.top_k(queries, k, query_id, query)
    part = _asked(queries, query_id, query).orderBy("token", "query_id").toArrow()
    empty = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    if not part.num_rows:
        return empty
    tokens, at = np.unique(np.array(part["token"].to_pylist(), object), return_inverse=True)
    names, query_at = np.unique(part["query_id"].to_numpy(), return_inverse=True)
    lowered = docs.select(F.col(doc_id).cast("long"), F.lower(text))
    counted = lowered.mapInArrow(_frequency_batches(tokens.tolist()), "code int, n long, words long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    held = {c: (n, w) for c, n, w in zip(*[x.to_pylist() for x in counted.columns], strict=True)}
    n_docs, n_words = held.pop(-1, (0, 0))
    df = np.zeros(len(tokens))
    df[list(held)] = [n for n, _ in held.values()]
    order = np.argsort(at, kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(at, minlength=len(tokens))))
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    average = max(1.0, n_words / n_docs) if n_docs else 1.0
    found = lowered.mapInArrow(_bm25_batches(tokens.tolist(), idf, query_at[order], begin, part["qtf"].to_numpy()[order].astype(float), names.tolist(), average, k), "query_id long, doc_id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), k)


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", unique: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The k best of each query with their ranks; ties by the unique column."""
    return scores.withColumn(rank, ranked(list(by), F.col(score).desc(), F.col(unique).asc())).filter(F.col(rank) <= k)


class _Best:
    """The k best rows of each query so far, by score rounded to six digits, then id; scores lie as whole millionths, nan above all."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), UNSET)
        self.id = np.zeros((len(queries), k), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Rows for the queries at asking (all without it), VECTOR_CELLS scores at a time."""
        asking = np.arange(len(self.queries)) if asking is None else asking
        for at in range(0, len(ids), VECTOR_ROWS):
            part, own = rows[at : at + VECTOR_ROWS], ids[at : at + VECTOR_ROWS]
            step = max(1, VECTOR_CELLS // len(part))
            for lo in range(0, len(asking), step):
                self._merge(asking[lo : lo + step], own, part)

    def _merge(self, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = self.queries[asking] @ rows.T
        edge = self.score[asking, -1] / 1e6
        loose = self.score[asking, -1] == UNSET
        if loose.any() and len(ids) > self.k:
            edge[loose] = np.partition(scores[loose], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        q, c = np.nonzero(~(scores < edge[:, None] - SCORE_SLACK))
        if not len(q):
            return
        new = scores[q, c]
        new = np.where(np.isnan(new), 2_000_000, np.sign(new) * np.floor(np.abs(np.nan_to_num(new)) * 1e6 + 0.5)).astype(np.int64)
        some = np.bincount(q, minlength=len(asking)) > 0
        asking, q = asking[some], (np.cumsum(some) - 1)[q]
        held = np.repeat(np.arange(len(asking)), self.k)
        q, score, found = np.append(held, q), np.append(self.score[asking].ravel(), new), np.append(self.id[asking].ravel(), ids[c])
        order = np.lexsort((found, -score, q))
        n = np.bincount(q, minlength=len(asking))
        take = order[(np.cumsum(n) - n)[:, None] + np.arange(self.k)]
        self.score[asking], self.id[asking] = score[take], found[take]

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score) of what is held, in batches that neither side notices."""
        step = max(1, BATCH_ROWS // self.k)
        for lo in range(0, len(names), step):
            q, c = np.nonzero(self.score[lo : lo + step] > UNSET)
            score, ids = self.score[lo + q, c], self.id[lo + q, c]
            shown = np.where(score > 1_500_000, np.nan, score / 1e6)
            yield pa.RecordBatch.from_arrays([pa.array(names[lo + q]), pa.array(ids, mask=ids == NO_ID), pa.array(shown)], ["query_id", "doc_id", "score"])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {len(sizes)} lengths")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1 if len(column) and sizes[0].as_py() else 0)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def _block_top(queries: np.ndarray, names: np.ndarray, k: int):
    """Arrow mapper: (doc_id, vector) to the task's best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k)
        for batch in batches:
            if batch.num_rows:
                best.add(_ids(batch.column(0)), _unit(_vectors(batch.column(1))))
        yield from best.batches(names)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score), rows of a query together, to (query_id, their ids, their scores)."""
    for batch in batches:
        if batch.num_rows:
            query = batch.column(0).to_numpy()
            head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            at = pa.array(np.append(head, len(query)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(query[head]), *[pa.ListArray.from_arrays(at, batch.column(i)) for i in (1, 2)]], ["query_id", "doc_id", "score"])


def _merged(k: int):
    """Grouped mapper: the lists that tasks hand on for some queries to the k best of each query with their ranks, a few lists at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, ids, score, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        step = max(1, BATCH_ROWS // k)
        for whole in batches:
            for batch in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
                n = pc.list_value_length(batch.column("doc_id")).to_numpy()
                query = np.append(query, np.repeat(batch.column("query_id").to_numpy(), n))
                ids = np.append(ids, _ids(pc.list_flatten(batch.column("doc_id"))))
                score = np.append(score, pc.list_flatten(batch.column("score")).to_numpy())
                order = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score), query))
                head = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1]))
                rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                order, rank = order[rank < k], rank[rank < k]
                query, ids, score = query[order], ids[order], score[order]
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=ids == NO_ID), pa.array(score), pa.array(rank + 1, pa.int32())], ["query_id", "doc_id", "score", "rank"])

    return run


def _lists_of(mapper):
    """The Arrow mapper with its rows as lists."""
    return lambda batches: _listed(mapper(batches))


def _grid_top(k: int):
    """Cogroup of a block of queries and a part of the corpus: the best rows of each query in it."""

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and corpus.num_rows:
            best = _Best(_unit(_vectors(queries["v"])), k)
            best.add(_ids(corpus["doc_id"]), _unit(_vectors(corpus["v"])))
            parts = [*_listed(best.batches(_ids(queries["id"])))]
        return pa.Table.from_batches(parts, pa.schema([("query_id", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))]))

    return run


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str) -> DataFrame:
    """(query_id, doc_id, score, rank) by exact cosine; zero vectors score 0.

    Queries of up to BLOCK_BYTES travel to the corpus, whose tasks hold VECTOR_CELLS
    scores at a time and hand on their best rows only. More queries meet the corpus
    in a grid of blocks of that size: each block of either side goes to the cells of
    its row or column, so that neither plan nor driver grows with the queries.
    A task hands on one list a query, and lists of some queries are merged where
    they meet: the single rows that Spark moves are those of the result.
    """
    rows = corpus.select(F.col(vec_id).cast("long").alias("doc_id"), F.col(vector).alias("v")).filter("v is not null")
    wanted = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null")
    # a query takes its vector and k scores and ids
    blocks = lambda df, least: max(1, -(-int(df.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(least)))).first()[0] or 0) // BLOCK_BYTES))
    asked = blocks(wanted, 2 * k)
    schema, lists = "query_id long, doc_id long, score double, rank int", "query_id long, doc_id array<long>, score array<double>"
    if asked == 1:
        part = wanted.orderBy("id").toArrow()
        if not part.num_rows:
            return rows.sparkSession.createDataFrame([], schema)
        # a task streams its rows, however many they are, and each task more makes a list more for every query
        rows = rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
        found = rows.mapInArrow(_lists_of(_block_top(_unit(_vectors(part["v"])), _ids(part["id"]), k)), lists)
    else:
        lie = blocks(rows, 0)
        spread = lambda df, own, n, other, m: df.withColumns({own: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        cells = spread(wanted, "q", asked, "c", lie).groupBy("q", "c"), spread(rows, "c", lie, "q", asked).groupBy("q", "c")
        found = cells[0].cogroup(cells[1]).applyInArrow(_grid_top(k), lists)
    return found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(MERGE_GROUPS * asked))).applyInArrow(_merged(k), schema)


class VectorIndex:
    """Approximate cosine search: every row lies in the cell of its nearest centroid; a query visits its nearest cells only.

    Centroids come from k-means on at most SAMPLE rows (a keyed hash chooses);
    all rows are assigned. How many cells a query visits is measured on the
    sample: as many as hold WANTED of the true neighbours of JUDGED of its rows.
    """

    SAMPLE = 20_000
    JUDGED, NEIGHBOURS, WANTED = 300, 10, 0.96

    def __init__(self, centroids: np.ndarray, probes: int, vec_id: str, vector: str):
        self.centroids, self.probes, self.vec_id, self.vector = centroids, probes, vec_id, vector

    @classmethod
    def fit(cls, corpus: DataFrame, vec_id: str, vector: str, cells: int | None = None, rounds: int = 12, seed: int = 3) -> VectorIndex:
        chosen = corpus.filter(F.col(vector).isNotNull()).select(vector, vec_id).orderBy(F.xxhash64(F.lit(seed), vec_id), vec_id).limit(cls.SAMPLE).toArrow()
        rows = _unit(np.array([np.asarray(v, float) for v in chosen[vector].to_pylist()]).reshape(chosen.num_rows, -1))
        cells = cells or max(1, int(np.sqrt(len(rows))))
        centroids = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]]
        for _ in range(rounds):
            own = (rows @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, own, rows)
            centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, _unit(sums), centroids)
        judged = rows[: cls.JUDGED]
        near = np.argsort(-(judged @ rows.T), axis=1)[:, : cls.NEIGHBOURS]
        order = np.argsort(-(judged @ centroids.T), axis=1, kind="stable").argsort(axis=1)  # place of each cell among a query's visits
        place = np.take_along_axis(order, (rows @ centroids.T).argmax(axis=1)[near], 1)
        probes = 1 + int(np.quantile(place, cls.WANTED, method="higher")) if place.size else 1
        return cls(centroids, probes, vec_id, vector)

    def assigned(self, corpus: DataFrame) -> DataFrame:
        """(cell, doc_id, vector) of every row; written by cell, a search reads only the cells that its queries visit."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _unit(_vectors(batch.column(1)))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array((rows @ centroids.T).argmax(axis=1), pa.int32()), batch.column(0), listed], ["cell", "doc_id", "vector"])

        rows = corpus.select(F.col(self.vec_id).cast("long"), F.col(self.vector)).filter(F.col(self.vector).isNotNull())
        return rows.mapInArrow(run, "cell int, doc_id long, vector array<double>")

    def top_k(self, index: DataFrame, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank); queries in blocks of at most BLOCK_BYTES."""
        wanted = queries.select(F.col(self.vec_id).cast("long").alias("id"), F.col(self.vector).alias("v")).filter("v is not null")
        probes = min(len(self.centroids), probes or self.probes)
        blocks = max(1, -(-wanted.count() * max(self.centroids.shape[1], 2 * k) * 8 // BLOCK_BYTES))
        out = index.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
        for b in range(blocks):
            part = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
            if part.num_rows:
                matrix = _unit(_vectors(part["v"]))
                visits = np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")[:, :probes]
                visited = index.filter(F.col("cell").isin(*np.unique(visits).tolist()))
                out = out.unionAll(visited.mapInArrow(_cell_top(matrix, _ids(part["id"]), visits, k), out.schema))
        return top_k(out.withColumn("score", F.round("score", 6)), k)


def _cell_top(matrix: np.ndarray, names: np.ndarray, visits: np.ndarray, k: int):
    """Arrow mapper: (cell, doc_id, vector) to the task's best rows of each query in the cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(matrix, k)
        order, visited = np.argsort(visits, axis=None, kind="stable"), np.sort(visits, axis=None)
        for batch in batches:
            if batch.num_rows:
                cell, ids, rows = batch.column(0).to_numpy(), _ids(batch.column(1)), _vectors(batch.column(2))
                for c in np.unique(cell):
                    at, (lo, hi) = np.flatnonzero(cell == c), np.searchsorted(visited, [c, c + 1])
                    if hi > lo:
                        best.add(ids[at], rows[at], order[lo:hi] // visits.shape[1])
        yield from best.batches(names)

    return run


def reciprocal(rank: str, k: int = RRF_K) -> Column:
    return 1.0 / (k + F.col(rank))


def fuse_lists(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rrf, rank) from ranked lists (query_id, doc_id, rank, score) of one channel."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(reciprocal("rank", k)), 9).alias("rrf"), F.max("score").alias("score"))
    return fused.withColumn("rank", ranked(["query_id"], F.desc("rrf"), F.desc("score"), F.asc("doc_id")))


def fuse_channels(keyword: DataFrame, semantic: DataFrame, most: int | None = None, k: int = RRF_K) -> DataFrame:
    """Full outer fusion of two ranked lists; the keyword rank is that of its own fusion."""
    left = keyword.select("query_id", "doc_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    right = semantic.select("query_id", "doc_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    both = left.join(right, ["query_id", "doc_id"], "full_outer")
    rrf = F.coalesce(reciprocal("keyword_rank", k), F.lit(0.0)) + F.coalesce(reciprocal("semantic_rank", k), F.lit(0.0))
    both = both.withColumn("rrf", F.round(rrf, 9))
    out = both.withColumn("retrieval_rank", ranked(["query_id"], F.desc("rrf"), F.coalesce("keyword_rank", F.lit(1 << 30)), F.asc("doc_id")))
    return out if most is None else out.filter(F.col("retrieval_rank") <= most)


def fuse_scored(pairs: DataFrame, allowed: Column | None, retrieve_k: int, top: int, local: Sequence[str] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """Fuse two scores of the same pairs (query_id, doc_id, a_score, b_score).

    Ranks are taken within `local`. With `allowed`, ranks stay those of all
    pairs and only membership is filtered; a query with no allowed pair falls
    back to all of its pairs.
    """
    by = list(local)
    out = pairs.withColumns({f"{c}_rank": ranked(by, F.desc(f"{c}_score"), F.asc("doc_id")) for c in "ab"})
    if allowed is not None:
        from pyspark.sql import Window

        out = out.withColumn("_in", allowed)
        some = F.max("_in").over(Window.partitionBy(*by))
        out = out.withColumn("_some", some).filter(F.col("_in") | ~F.col("_some")).drop("_in", "_some")
    out = out.withColumns({f"_{c}": ranked(by, F.asc(f"{c}_rank"), F.asc("doc_id")) for c in "ab"})
    out = out.filter((F.col("_a") <= retrieve_k) | (F.col("_b") <= retrieve_k)).drop("_a", "_b")
    out = out.withColumn("rrf", F.round(reciprocal("a_rank", k) + reciprocal("b_rank", k), 9))
    return out.withColumn("rank", ranked(by, F.desc("rrf"), F.asc("doc_id"))).filter(F.col("rank") <= top)


def activity_shortlist(pairs: DataFrame, retrieve_k: int, top: int) -> DataFrame:
    """Fused activities of each query, of the phases that its phase is open to.

    pairs: query_id, query_phase, doc_id (the activity), activity_phase, a_score,
    b_score, for all activities of a query. Ranks are those of all activities; a
    query whose phase has no bucket, or no activity in it, keeps them all.
    """
    table = [(q, a) for q, phases in PHASE_BUCKETS.items() for a in phases]
    buckets = pairs.sparkSession.createDataFrame(table, "query_phase string, activity_phase string").withColumn("_open", F.lit(True))
    both = pairs.join(F.broadcast(buckets), ["query_phase", "activity_phase"], "left")  # a fixed table of a few rows
    return fuse_scored(both, F.coalesce("_open", F.lit(False)), retrieve_k, top).drop("_open")


def rerank(pairs: DataFrame, score: str, k: int, by: str = "query_id", prior: str = "retrieval_rank") -> DataFrame:
    """Order by pair score, then by retrieval rank; keep k with final_rank."""
    return pairs.withColumn("final_rank", ranked([by], F.desc(score), F.asc(prior))).filter(F.col("final_rank") <= k)

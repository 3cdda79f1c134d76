"""Many queries: index join and grid give what one travelling block gives."""

import random

from dossier.operators import retrieval as R


def rows_of(df):
    return {tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect()}


def test_keyword_queries_beyond_a_block(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, None if i == 7 else " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12)))) for i in range(150)], "d long, t string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 33)}" for _ in range(rng.randint(0, 4)))) for i in range(30)], "q long, t string")
    one = rows_of(R.bm25_top_k(docs, queries, 5, "d", "t", "q", "t"))
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    assert rows_of(R.bm25_top_k(docs, queries, 5, "d", "t", "q", "t")) == one and len(one) > 80
    assert rows_of(R.bm25_top_k(docs.limit(0), queries, 5, "d", "t", "q", "t")) == set()


def test_vector_queries_beyond_a_block(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda: [float(rng.randint(-3, 3)) for _ in range(6)]
    corpus = spark.createDataFrame([(i, [0.0] * 6 if i == 9 else None if i == 10 else vector()) for i in range(300)], "i long, v array<double>").repartition(3)
    queries = corpus.filter("i % 4 = 1")
    one = rows_of(R.vector_top_k(corpus, queries, 7, "i", "v"))
    assert len(one) == 7 * queries.filter("v is not null").count()
    monkeypatch.setattr(R, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(R, "SCORE_CELLS", 100)
    assert rows_of(R.vector_top_k(corpus, queries, 7, "i", "v")) == one
    assert rows_of(R.vector_top_k(corpus, queries.limit(0), 7, "i", "v")) == set()


def _batches(rows, size):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part))), pa.array([*part], pa.list_(pa.float64()))], ["doc_id", "v"]) for lo in range(0, len(rows), size) for part in [rows[lo : lo + size]]]


def test_a_task_holds_few_scores_and_hands_on_its_best_rows_only():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    rows, k = R._unit(rng.normal(size=(12_000, 8))), 5
    rows[6000:6300] = rows[0]  # copies
    asked = rows[:3000]
    batches = _batches(rows, 6000)
    tracemalloc.start()
    out = [*R._block_top(asked, np.arange(3000), k)(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 3000 * k and peak < 120e6
    got = sorted(zip(*[np.concatenate([b.column(i).to_numpy() for b in out]) for i in range(3)], strict=True))
    for q in (0, 17, 2999):
        scores = np.round(rows @ asked[q], 6)
        assert [(i, s) for x, i, s in got if x == q] == sorted((i, scores[i]) for i in np.lexsort((np.arange(12_000), -scores))[:k])


def test_a_task_of_the_index_hands_on_its_best_rows_only():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows, k = R._unit(rng.normal(size=(2000, 8))), 5
    cell = rng.integers(0, 4, 2000).astype(np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(cell[b.column(0).to_numpy()]), *b.columns], ["cell", "doc_id", "vector"]) for b in _batches(rows, 500)]
    visits = np.stack([rng.permutation(4)[:2] for _ in range(100)])
    out = [*R._cell_top(rows[:100], np.arange(100), visits, k)(iter(batches))]
    assert sum(b.num_rows for b in out) == 100 * k
    got = sorted(zip(*[np.concatenate([b.column(i).to_numpy() for b in out]) for i in range(2)], strict=True))
    for q in range(100):
        scores = np.where(np.isin(cell, visits[q]), np.round(rows @ rows[q], 6), -9)
        assert [i for x, i in got if x == q] == sorted(np.lexsort((np.arange(2000), -scores))[:k])


def test_best_rows_are_handed_on_in_small_batches():
    import numpy as np

    from dossier.operators import retrieval as R

    best = R._Best(R._unit(np.random.default_rng(1).normal(size=(3000, 4))), 50)
    best.add(np.arange(60), R._unit(np.random.default_rng(2).normal(size=(60, 4))))
    sizes = [b.num_rows for b in best.batches(np.arange(3000))]
    assert sum(sizes) == 150_000 and max(sizes) <= 1 << 16


def test_a_search_is_over_before_its_ranking_is_joined(spark):
    from dossier.plans import registry

    registry.load()
    for name in ("rrf_hybrid", "rerank_order", "recall_at_k", "metric_summary"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "FlatMapCoGroups" not in plan


def test_tasks_hand_on_one_list_a_query_and_lists_are_merged():
    import math

    import numpy as np
    import pyarrow as pa

    flat = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])
    tasks = [[(1, 5, 0.5), (1, 9, 0.25), (2, 5, 0.75)], [(1, None, 0.5), (1, 3, 0.5), (2, 4, math.nan)], [(2, 6, 0.75), (2, 7, 0.1), (3, 8, -1.0)], []]
    lists = [b for rows in tasks for b in R._listed(iter([flat(rows)]))]
    assert [b.num_rows for b in lists] == [2, 2, 2]
    (out,) = R._merged(3)(iter(lists))
    assert [tuple(map(str, r.values())) for r in out.to_pylist()] == [
        ("1", "None", "0.5", "1"), ("1", "3", "0.5", "2"), ("1", "5", "0.5", "3"),
        ("2", "4", "nan", "1"), ("2", "5", "0.75", "2"), ("2", "6", "0.75", "3"), ("3", "8", "-1.0", "1"),
    ]
    rng = np.random.default_rng(7)
    rows = [(q, d, float(s)) for q in range(40) for d, s in enumerate(rng.integers(0, 9, 3000) / 8)]
    batches = [b for lo in range(0, 3000, 300) for b in R._listed(iter([flat([r for r in rows if lo <= r[1] < lo + 300])]))]
    (out,) = R._merged(5)(iter(batches))
    assert [tuple(r.values()) for r in out.to_pylist()] == [(q, d, s, n + 1) for q in range(40) for n, (_, d, s) in enumerate(sorted(rows[3000 * q : 3000 * q + 3000], key=lambda r: (-r[2], r[1]))[:5])]


def test_a_search_over_many_splits_moves_few_lists_and_no_single_rows(spark):
    rng = random.Random(8)
    corpus = spark.createDataFrame([(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(400)], "i long, v array<double>").repartition(60)
    found = R.vector_top_k(corpus, corpus.filter("i % 20 = 0"), 6, "i", "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert f"Repartition {R.TASKS_A_CORE * spark.sparkContext.defaultParallelism}, false" in plan
    assert len(rows_of(found)) == 20 * 6

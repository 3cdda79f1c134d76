"""Clustering against a plain version in Python integers; trees against every point."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from dossier.llm import centroid_clustering as cc
from dossier.llm.kd_tree import KdTree, distances

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, point string, ids string, `begin` int"


def plain(rows, k, rounds, seed, dimensions, scale=1024):
    kept = [(v, tuple(math.floor(scale * float(np.float32(x))) for x in e)) for v, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"{seed}:{v}".encode()).hexdigest(), q) for v, q in kept if v is not None)
    centroids = [list(q) for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        members = [[] for _ in centroids]
        for _, q in kept:
            members[near(q)[1]].append(q)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    if not centroids:
        return Counter()
    out = [(v, near(q)[1], near(q)[0]) for v, q in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((v, c, d, inertia[c], sum(inertia.values()), digest[c]) for v, c, d in out)


def found(frame, **how):
    rows = cc.with_inertia(*cc.centroid_clustering(frame, **how)).collect()
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    out = [(i, [rng.gauss(m, 0.05) for m in rng.choice(centres)]) for i in range(700)]
    hot = out[0][1]
    out += [(1000 + i, hot) for i in range(400)]  # a third are copies
    out += [(5, out[5][1]), (5, out[6][1]), (None, hot), (None, [0.0] * 6)]  # repeated ids, rows without one
    return out + [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2005, [float("nan")] * 6), (2006, [float("inf")] * 6), (2007, [float("-inf")] * 6), (2008, [-0.0, -1e-9, 1e-9, -3.2, 30000.0, 5.0])]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(v, e, 0, 9, "p", "i", 4) for v, e in rows], SCHEMA).repartition(parts)


def test_against_a_plain_version(spark, rows, monkeypatch):
    expected = plain(rows, 8, 10, 3, 6)
    assert sum(expected.values()) == len(rows) - 8
    assert found(frame(spark, rows), dimensions=6) == expected
    monkeypatch.setattr(cc, "BLOCK", 64)
    assert found(frame(spark, rows, 7), dimensions=6) == expected


def test_ties_few_and_no_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0]) for i in range(36)]  # many equal distances
    for k in (1, 4, 8, 50):
        assert found(frame(spark, grid), k=k, dimensions=3) == plain(grid, k, 10, 3, 3)
    same = [(i, [1.0, 2.0, 3.0]) for i in range(20)]  # equal centroids: the first takes all, the others stay empty
    assert found(frame(spark, same), k=3, dimensions=3) == plain(same, 3, 10, 3, 3)
    assert not found(frame(spark, []), dimensions=3)
    assert not found(frame(spark, [(None, [1.0, 2.0, 3.0])]), dimensions=3)  # no seed, no cluster


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="leave 64 bits"):
        found(frame(spark, [(1, [1e30, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])]), dimensions=3)


def test_tree_equals_all_points():
    rng = np.random.default_rng(5)
    for size, spread in ((1, 5), (50, 3), (4000, 400), (3000, 1 << 25)):
        points = np.clip(rng.normal(0, spread, (size, 8)).astype(np.int64), -(1 << 25), 1 << 25)
        centroids = points[rng.integers(0, size, 5)] + rng.integers(-2, 3, (5, 8))
        tree, order = KdTree.build(points)
        exact = np.array([[sum(int(a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in points[order]])
        label = exact.argmin(axis=1)
        assert (distances(tree.points, centroids) == exact).all()
        assert (tree.labels(centroids) == label).all()
        count, sums = tree.totals(centroids)
        assert (count == np.bincount(label, minlength=5)).all()
        assert (sums == np.stack([points[order][label == c].sum(axis=0) for c in range(5)])).all()


def test_nodes_are_assigned_whole_where_clusters_are_apart():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 4000, (4, 16)).astype(np.int64)
    points = np.concatenate([c + rng.integers(-50, 50, (1000, 16)) for c in centres])
    tree, _ = KdTree.build(points)
    whole = sum((tree.end[nodes] - tree.begin[nodes])[open_to.sum(axis=1) == 1].sum() for nodes, open_to in tree.walk(centres))
    assert whole > 0.9 * len(points)

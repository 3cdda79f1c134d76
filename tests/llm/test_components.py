"""Connected components on chains, stars, rings and a hub with most of the edges."""

import random

import pytest

from dossier.llm.components import connected_components


def expected(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(root)}


def shapes():
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(30)]
    shuffled = rng.sample(range(1000, 1024), 24)
    star = [(5000, i) for i in range(4000, 4300)]
    loose = [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(250)]
    return {"chain": chain, "shuffled chain": list(zip(shuffled, shuffled[1:])), "hub and the rest": star + loose + [(4299, 6000)], "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)], "one edge": [(9, 4)]}


@pytest.mark.parametrize("name", list(shapes()))
def test_components(spark, name):
    edges = shapes()[name]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == expected(edges) and len(found) == len(expected(edges))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

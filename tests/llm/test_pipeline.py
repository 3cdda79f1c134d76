"""The pipeline's stages against a plain-Python version of their decisions."""

import os
import re

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else docs.collect())
        if k < 4:
            assert docs.columns == columns
    quality, exact, near, cut, packed = seen
    assert all(len(WORD.findall(t)) >= 50 for t in quality.values())

    groups = {}
    for d, t in quality.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d))
    assert set(exact) == {min(g)[1] for g in groups.values()}

    sets, root = {d: shingles(t) for d, t in exact.items()}, {d: d for d in exact}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near) == {d for d in exact if find(d) == d}

    first = {}
    for d, t in sorted(near.items()):
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in near.items():
        w = WORD.findall(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        assert (d in cut) == bool(kept)
        assert not kept or WORD.findall(cut[d]) == kept
        assert any(gone) or cut[d] == t

    assert {r["doc_id"] for r in packed} == set(cut)
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048

"""Two-channel shortlists against scoring every pair; what has no words, vector or cell; the bound of the matrix."""

import math
import random
import re
from collections import Counter

import pytest

from dossier.functions.vocabulary import PHASE_BUCKETS
from dossier.operators import shortlist as L

ASKED = "query_id long, text string, vector array<double>, phase string, systems array<string>, cell_phases array<string>"
KNOWN = "activity_id long, text string, vector array<double>, phase string, systems array<string>"


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain(queries, activities, retrieve, top):
    activities = sorted(activities)
    n, df = len(activities), Counter(t for a in activities for t in set(tokens(a[1])))
    average = max(1.0, sum(len(tokens(a[1])) for a in activities) / max(1, n))

    def keyword(text, a):
        mine, tf = Counter(tokens(text)), Counter(tokens(a[1]))
        return round(sum(q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * sum(tf.values()) / average)) for t, q in mine.items() if tf[t]), 6)

    def cosine(u, v):
        norm = math.sqrt(sum(x * x for x in u or ())) * math.sqrt(sum(x * x for x in v or ()))
        return round(sum(x * y for x, y in zip(u, v, strict=True)) / norm, 6) if norm else 0.0

    out = set()
    for q, text, vector, phase, systems, phases in queries:
        scores = [[keyword(text, a) for a in activities], [cosine(vector, a[2]) for a in activities]]
        orders = [sorted(range(n), key=lambda i, s=s: (-s[i], activities[i][0])) for s in scores]
        bucket = PHASE_BUCKETS.get(phase or "")
        open_to = [i for i in range(n) if bucket and activities[i][3] in bucket] or [*range(n)]
        cell = [i for i in range(n) if set(systems or ()) & set(activities[i][4] or ()) and activities[i][3] in (phases or ())]
        chosen = {i for o in orders for i in [x for x in o if x in open_to][:retrieve]}
        for source, members, ranked in (("text", chosen, orders), ("cell", cell, [[x for x in o if x in cell] for o in orders])):
            places = [{i: r for r, i in enumerate(o, 1)} for o in ranked]
            fused = sorted((-round(1 / (60 + places[0][i]) + 1 / (60 + places[1][i]), 9), activities[i][0], i) for i in members)
            for rank, (rrf, a, i) in enumerate(fused[:top], 1):
                out.add((q, source, a, scores[0][i], scores[1][i], places[0][i], places[1][i], -rrf, rank))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    vector = lambda: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]
    phases = ["procurement", "system_design", "delivery", "commissioning", "", None]
    activities = [(i * 3, text(rng.randint(0, 6)), rng.choice([vector(), None]), rng.choice(phases), rng.sample(["a", "b", "c"], rng.randint(0, 2))) for i in range(60)]
    activities += [(500, None, [0.0] * 4, None, None), (501, activities[0][1], activities[0][2], activities[0][3], ["a"])]
    queries = [(i, rng.choice([text(rng.randint(0, 40)), None, "unheard words", "W1, w2! " * 50]), rng.choice([vector(), vector(), None, [0.0] * 4]), rng.choice([*PHASE_BUCKETS, "", None]), rng.sample(["a", "b", "x"], rng.randint(0, 2)), rng.choice([None, [], ["procurement", "delivery"], ["system_design"]])) for i in range(80)]
    return queries, activities


def found(spark, queries, activities, retrieve, top):
    rows = L.two_channel_shortlist(spark.createDataFrame(queries, ASKED).repartition(3), spark.createDataFrame(activities, KNOWN), retrieve, top).collect()
    assert len(rows) == len(set(rows))
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}


def test_against_every_pair(spark, tables, monkeypatch):
    queries, activities = tables
    known = [(a, t, v, p or "", s) for a, t, v, p, s in activities]
    expected = plain(queries, known, 5, 4)
    assert found(spark, queries, activities, 5, 4) == expected
    monkeypatch.setattr(L, "CELLS", 100)  # one row a slice
    assert found(spark, queries, activities, 5, 4) == expected
    assert {q for q, source, *_ in expected if source == "text"} == {q[0] for q in queries}  # none goes without


def test_few_and_many(spark, tables):
    queries, activities = tables
    assert found(spark, queries, [], 5, 4) == set()
    assert found(spark, [], activities, 5, 4) == set()
    one = activities[:1]
    assert found(spark, queries, one, 50, 20) == plain(queries, [(a, t, v, p or "", s) for a, t, v, p, s in one], 50, 20)


def test_a_matrix_beyond_its_bound_is_refused(spark, tables, monkeypatch):
    monkeypatch.setattr(L, "MATRIX_BYTES", 1000)
    with pytest.raises(ValueError, match="scoring matrix"):
        found(spark, *tables, 5, 4)

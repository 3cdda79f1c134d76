"""Rows that repeat a doc_id, with equal and with different texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from dossier.llm import exact_dedup

BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, digest string, rank int, best string, place int, _digest string"


def table(spark):
    rng = random.Random(9)
    texts = ["a b", "ab", "a  b", "c", None, "", " \r\n", "é\x0bx", "éx", "d" * 100_000]
    rows = [(rng.choice([1, 2, 3, 7, 7, 7, None]), rng.choice(texts)) for _ in range(400)]
    rows += [(7, "same")] * 4 + [(9, "same")]
    return rows, spark.createDataFrame([(*r, "x", i, "y", 1, "z") for i, r in enumerate(rows)], SCHEMA).repartition(5)


def verdicts(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), d is None, d or 0))
    return {hashlib.sha256(k.encode()).hexdigest(): (min(g), len(g)) for k, g in groups.items()}


def test_one_row_of_each_group_is_kept(spark):
    rows, docs = table(spark)
    expected = verdicts(rows)
    for counters in (4096, 1):
        found = exact_dedup.exact_dedup(docs, counters).collect()
        assert len(found) == len(rows)
        assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(expected.keys())
        for r in found:
            (_, unnamed, keep), size = expected[r["text_sha256"]]
            assert r["group_size"] == size and r["keep_id"] == (None if unnamed else keep)
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        whole = exact_dedup.without_copies(docs, counters)
        assert whole.columns == docs.columns
        kept = whole.collect()
        assert sorted((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(v[0] for v in expected.values())
        assert all(r["digest"] == "x" and r["_digest"] == "z" for r in kept)

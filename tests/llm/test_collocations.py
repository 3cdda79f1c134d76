"""Collocations against counting every run of words; bitmaps against positions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from dossier.llm import collocations as co
from dossier.llm.key_filter import KeySet, bucket_of, key_set, spread
from dossier.llm.phrase_bitmaps import Shard

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, key long, `len` int, rank int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support, longest=5, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and a >= support}
        inside = {(q[i : i + k], a) for q, a in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)}
        rows = []
        for p, a in found.items():
            if len(p) > 1 and (p, a) not in inside:
                score, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(frame, **how):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in co.collocations(frame, **how).collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i % 40 if i % 7 else None, t, x, 1, "p", 2, 3, 4) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "Éa", "éa", "straße", "日本", "x#y", "\x00z", "no-break space", *[f"w{i}" for i in range(12)]]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", ";", "\x0b", "\x0c", "!?", ":"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    out = [(text(rng.choice((0, 1, 5, 60))), rng.choice(("en", "de", None, "und", ""))) for _ in range(300)]
    fixed = "one two three four five six"
    out += [(fixed, "en")] * 30 + [(f"{fixed}. three four", "en")] * 3 + [("ha " * 200, "en")] * 4
    return out + [(None, "en"), ("", "fr"), (" \t.,;\n", "xx"), (None, None), (text(40_000), "en"), ("y" * 100_000 + " end", "de")]


def test_against_counting(spark, rows):
    expected = plain(rows, 20)
    assert len(expected) > 300
    assert found(frame(spark, rows), support=20) == expected
    assert found(frame(spark, rows, 5), support=20, shard_words=700) == expected  # many shards
    assert found(frame(spark, rows), support=20, power=16) == expected  # a full filter prunes less, no more
    assert found(frame(spark, rows), support=20, top=7) == plain(rows, 20, top=7)
    assert found(frame(spark, rows), support=20, longest=3) == plain(rows, 20, longest=3)
    assert found(frame(spark, rows), support=20, longest=2) == plain(rows, 20, longest=2)


def test_ties_and_no_rows(spark):
    rows = [("b a. a b. c d. d c", "en")] * 10  # equal scores and counts: by phrase
    assert found(frame(spark, rows), support=10) == plain(rows, 10)
    assert [r[2] for r in found(frame(spark, rows), support=10)] == ["a b", "b a", "c d", "d c"]
    assert found(frame(spark, []), support=1) == []
    assert found(frame(spark, [(None, None), ("", "en")]), support=1) == []


def test_scores_beyond_64_bits(spark):
    values = [(10**12, 10**13, 10**12 + 7, 10**12 + 9), (3, 5, 3, 4), (7 * 10**15, 10**16, 8 * 10**15, 9 * 10**15)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(values, "a long, n long, l long, r long").select("a", "n", "l", "r", co.exact_score(*map(F.col, "anlr")).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == sorted((*v, 1000 * v[0] * v[1] // (v[2] * v[3])) for v in values)


def test_bitmaps_equal_positions():
    rng = np.random.default_rng(2)
    everything = KeySet(np.full(1 << 13, 255, np.uint8), 16, 0)
    for size in (1, 15, 16, 17, 64, 1000):
        words = rng.integers(1, 6, size).astype(np.uint64)
        begins = rng.random(size) < 0.1
        begins[0] = True
        shard, got = Shard(words, begins, 5, everything), Counter()
        spelt = {}

        def seen(length, level, shard=shard, got=got, spelt=spelt):
            before = spelt.get(length - 1)
            spelt[length] = [(*(before[p] if length > 1 else ()), int(shard.words[w])) for p, w in zip(level.parent, level.last, strict=True)]
            got.update(dict(zip(spelt[length], level.count.tolist(), strict=True)))

        shard.follow(5, lambda length, new, old: np.ones(len(new.key), bool), seen)
        expected = Counter()
        for k in range(1, 6):
            for i in range(size - k + 1):
                if not begins[i + 1 : i + k].any():
                    expected[tuple(words[i : i + k].tolist())] += 1
        assert got == expected


def test_filters_hold_every_key(spark):
    rng = np.random.default_rng(1)
    mine, others = (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) for n in (5000, 10_000))
    for buckets in (0, 5, 20):
        short = spread(bucket_of(mine, buckets), mine & np.uint64(0xFFFFFFFF)).view(np.int64)
        known = key_set(spark.createDataFrame([(int(k),) for k in short], "key long"), buckets)
        assert known.has(mine).all()
        assert known.has(others).mean() < 0.05
    assert not key_set(spark.createDataFrame([], "key long")).has(mine).any()


def test_counts_of_a_bucket_add_up():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    parts = [co._packed(keys, rng.integers(1, 9, 400), 3) for _ in range(5)]
    whole = pa.Table.from_batches(parts)
    got = [co._merge_keys(25)(whole.filter(pc.equal(whole["bucket"], b)))["key"].to_pylist() for b in set(whole["bucket"].to_pylist())]
    total = Counter()
    for row in whole.to_pylist():
        for k, n in zip(np.frombuffer(row["keys"], np.uint32).tolist(), np.frombuffer(row["counts"], np.uint32).tolist(), strict=True):
            total[row["bucket"], k] += n
    expected = [(b, k) for (b, k), n in total.items() if n >= 25]
    assert 0 < len(expected) < 400
    assert sorted(x for part in got for x in part) == sorted(spread(np.array([b for b, _ in expected]), np.array([k for _, k in expected])).view(np.int64).tolist())

"""Every operator and pipeline stage on rows that repeat, null ids, very long texts, carriage returns, colliding words and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dossier.llm import jaccard_join, language_id, packing, quality_rules, sentencepieces, sharding, substring_dedup, token_counts, weak_quality
from dossier.llm.token_counts import load_tokenizer, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, shard int, class string, key long, row int, part string, kept boolean, component long, batch string, rest string, target int, votes string, `length` int"
EXTRA = (1, 2, "c", 3, 4, "p", True, 5, "b", "r", 6, "v", 7)


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def make_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, windows = text(120), "One sentence.\r\nNext line, here:\r\n" * 20
    morse = " ".join([thue_morse(2048), thue_morse(2048, "b", "a")])
    rows = [(5, base), (5, base), (5, base), (5, text(90)), (9, base), (None, base), (None, None), (3, windows), (4, windows), (7, None), (7, ""), (8, text(200_000)), (10, "x" * 300_000), (11, f"{thue_morse(2048)}\n{thue_morse(2048, 'b', 'a')}\n" + text(60))]
    rows += [(12, (thue_morse(2048) + " ") + text(5)), (13, (thue_morse(2048, "b", "a") + " ") * 1 + text(5)), (14, morse + " " + text(70)), (15, " \r\n\t"), (2, base), (16, "ünïcödé 日本語 " * 40), (16, "ünïcödé 日本語 " * 40)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ["en", "fr", None][i % 3], "s", len(t or ""), *EXTRA) for i, (d, t) in enumerate(ROWS)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from dossier.llm.frames import settled

    return settled(frame)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def later(d):
    return (d is None, d or 0)


def test_substring_dedup(docs):
    first, expected = {}, []
    for d, t in ROWS:
        w = words_of(t)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, later(d)), later(d))
    for d, t in ROWS:
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < later(d):
                gone[i : i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()]
    assert Counter(found) == Counter(expected)


def test_bucket_sizes_grow_with_the_input():
    for size in (10**8, 3 * 10**10, 10**12, 10**14):
        batches, bits = substring_dedup.plan_sizes(size)
        assert size / 6 / 2**bits <= 2**24 and size / batches <= 65 << 20
    assert substring_dedup.plan_sizes(10**14)[1] == 20


def test_token_counts(docs, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    size = lambda t: len(load_tokenizer(path).encode(t or "", add_special_tokens=False))
    found = token_counts.token_counts(docs, str(tmp_path / "cache"), path).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == Counter((d, len((t or "").encode()), size(t)) for d, t in ROWS)


def test_jaccard(docs):
    def shingles(t):
        w = words_of(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(t) for _, t in ROWS], {d: d for d, _ in ROWS if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(ROWS):
        for j, (b, _) in enumerate(ROWS):
            if i < j and None not in (a, b) and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    expected = [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(ROWS, sets)]
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()) == Counter(expected)


def test_sentencepiece(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, expected = sentencepiece.SentencePieceProcessor(model_file=path), []
    for d, t in ROWS:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert Counter(tuple(r) for r in sentencepieces.piece_digests(docs, path).collect()) == Counter(expected)


def test_sharding(docs):
    rows = sharding.shard(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_repeated_rows_are_dealt_independently(spark):
    """A thousand equal rows among others: every shard gets about its share, and no two lie together by rule."""
    table = spark.createDataFrame([(1, "same")] * 1000 + [(i, "other") for i in range(2, 1002)], "doc_id long, text string").repartition(2)
    rows = sharding.shard(table, shards=4).collect()
    per = Counter(r["shard"] for r in rows if r["doc_id"] == 1)
    assert all(200 <= per[s] <= 300 for s in range(4))
    first = sorted((r["slot"], r["doc_id"] == 1) for r in rows if r["shard"] == 0)
    runs = sum(a[1] != b[1] for a, b in zip(first, first[1:]))
    assert runs > 150


def test_packing(docs):
    path = tokenizer_path("word_bpe_49k.json")
    expected = Counter()
    for d, t in ROWS:
        ids = np.array([*load_tokenizer(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            expected[d, k, lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes())] += 1
    rows = packing.best_fit_packing(docs, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def base_counts(t):
    w = words_of(t)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = np.zeros(len(w), bool)
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            cover[i : i + 3] = True
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, int(cover.sum())


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] * 3, "doc_id long, quality int, toxic int")
    expected = []
    for d, t in ROWS:
        c = base_counts(t)
        expected.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    found = quality_rules.quality_rules(docs, labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == Counter(expected)
    assert all(0 <= r["quality_p"] <= 1 and not (r["kept"] and r["base_failed"]) for r in found)


def test_the_verdict_separates_planted_quality(spark):
    """Held-out accuracy of the classifier's verdict, and probabilities that mean what they say."""
    rng = random.Random(12)
    good = [f"{a}{b}" for a in ("re", "con", "sub", "in") for b in ("sult", "form", "ject", "vent", "tain")]
    bad = [f"{a}{b}" for a in ("buy", "win", "hot", "xxx") for b in ("now", "cash", "deal", "$$$", "!!!")]
    rows = []
    for i in range(600):
        kind = i % 3 > 0
        mixed = [rng.choice(good if (rng.random() < 0.85) == kind else bad) + str(rng.randrange(40)) for _ in range(80)]
        rows.append((i, " ".join(mixed), int(kind)))
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 400], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(table, labels).collect()}
    held = [(found[i], q) for i, _, q in rows if i >= 400]
    assert sum(r["kept"] == bool(q) for r, q in held) >= 0.95 * len(held)
    assert abs(np.mean([r["quality_p"] for r, _ in held]) - np.mean([q for _, q in held])) < 0.1
    # a doc_id that repeats without end gives the sample one row
    many = table.unionAll(table.filter("doc_id = 1").crossJoin(spark.range(3000)).select("doc_id", "text"))
    model, plain = quality_rules.fit_quality(many, labels), quality_rules.fit_quality(table, labels)
    assert np.allclose(model.weights, plain.weights)


def test_languages(docs):
    rows = language_id.identify_languages(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ROWS)
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in rows)
    assert Counter(r["doc_id"] for r in rows if r["lang_pred"] == "und") == Counter(d for d, t in ROWS if not any(c.isalpha() for c in t or ""))


def test_weak_quality(docs):
    rows = weak_quality.weak_quality(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ROWS)
    assert len({(r["votes"], r["score"]) for r in rows if r["doc_id"] == 16}) == 1


def test_weak_labels_against_known_quality(spark):
    """Posterior and score against the truth of planted texts."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(90, 160))]
        good = i % 4 > 0
        if good:
            text = "\n".join(" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, len(words), 12))
        else:
            text = "\n".join(["BUY NOW!!! $$$ | WIN | WIN #1"] * rng.randint(3, 8))
        rows.append((i, text, good))
    found = {r["doc_id"]: r for r in weak_quality.weak_quality(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()}
    assert np.mean([(found[i]["posterior"] > 0.5) == g for i, _, g in rows]) >= 0.98
    assert np.mean([found[i]["kept"] == g for i, _, g in rows]) >= 0.98


def test_expectation_maximisation_against_a_plain_version():
    """Two classes and independent labellers over single rows: counts begin at one, an abstention is no evidence."""
    rng = random.Random(5)
    n = len(weak_quality.LABELLERS)
    rows = []
    for _ in range(600):
        y = rng.random() < 0.6
        rows.append("".join("0" if rng.random() < 0.3 else "+" if (rng.random() < 0.8) == y else "-" for _ in range(n)))
    counts = Counter(rows)
    names = sorted(counts)
    post, _ = weak_quality.label_model(names, [counts[p] for p in names])
    votes = [["-0+".index(c) for c in r] for r in rows]
    p = [min(0.95, max(0.05, 0.5 + sum(v - 1 for v in r) / (2 * n))) for r in votes]
    for _ in range(100):
        balance = (sum(p) + 1) / (len(p) + 2)
        share = [[[1 + sum((q if good else 1 - q) for q, r in zip(p, votes) if r[j] == v) for j in range(n)] for v in range(3)] for good in (0, 1)]
        total = [[sum(share[g][v][j] for v in range(3)) for j in range(n)] for g in (0, 1)]
        new = []
        for r in votes:
            good, bad = balance, 1 - balance
            for j, v in enumerate(r):
                if v != 1:
                    good *= share[1][v][j] / total[1][j]
                    bad *= share[0][v][j] / total[0][j]
            new.append(good / (good + bad))
        p = new
    plain = dict(zip(rows, p))
    assert max(abs(plain[name] - x) for name, x in zip(names, post)) < 1e-6


def test_stages_take_awkward_and_empty_tables(docs, nothing, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(docs.sparkSession, docs, folder)
        if name != "best-fit packing":
            assert out.columns == docs.columns and 0 < out.count() <= len(ROWS), name
            assert all(r["class"] == "c" and r["rest"] == "r" for r in out.select("class", "rest").collect()), name
        assert stage(docs.sparkSession, nothing, folder).count() == 0, name

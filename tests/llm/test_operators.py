"""Each operator against a brute-force version on a small table with every awkward row."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dossier.llm import exact_dedup, jaccard_join, language_id, packing, quality_rules, sentencepieces, sharding, substring_dedup, token_counts, weak_quality
from dossier.llm.token_counts import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, batch int, digest string, token string"


def make_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Éa", "straße", "日本", "x#y", "(a)"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(200), text(60)
    near = lambda k: " ".join(w if rng.random() > k else "edit" + str(rng.random()) for w in base.split(" "))
    texts = [base, base, base.replace(" ", "\n"), base.upper(), near(0.01), near(0.01), near(0.02), near(0.3), text(30) + " " + passage + " " + text(40), text(80) + "\n" + passage, passage, text(10), text(49), text(50)]
    texts += ["", None, "  \t\n", "one", "one two three", "ONE two THREE", None, "", "line\nline\nline\nother line\n", "a b c " * 60, "###*** $$ %% && || <> " * 30, text(3000), "<|endoftext|> tail", " lead  two  \n x", "a▁b ▁▁ c", "\x00\x01 x"]
    langs = ["en", "de", None]
    rows = [(i * 3 + 1, t, langs[i % 3], "s", len(t or ""), "c", 1, "d", "t") for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


ROWS = make_rows()
NAMED = [r for r in ROWS if r[0] is not None]
TEXT = {r[0]: r[1] for r in NAMED}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def words_of(text):
    return WORD.findall(text or "")


def test_substring_dedup(docs, nothing):
    first = {}
    for d, t in sorted(TEXT.items()):
        w = words_of(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    rows = substring_dedup.substring_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    removed = 0
    for d, t in TEXT.items():
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (found[d]["n_words"], found[d]["n_removed"], found[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += sum(gone)
    assert removed > 100
    assert [r["n_removed"] for r in rows if r["doc_id"] is None and r["n_words"]] == [200]  # later than all named rows
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_rows_without_repeats_keep_columns(docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r for r in out.collect()}
    assert 4 not in found  # an exact copy of document 1
    assert found[1]["text"] == TEXT[1]
    for d, t in TEXT.items():
        if len(words_of(t)) < 50:  # nothing to remove: unchanged, null too
            assert found[d]["text"] == t
    cut = found[28]  # after a text of its own, the passage that document 25 has
    assert words_of(cut["text"]) == words_of(TEXT[28])[:80] and cut["n_chars"] == len(cut["text"])


def test_token_counts(spark, docs, nothing, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    tokenizer = token_counts.load_tokenizer(path)
    out = token_counts.token_counts(docs, cache, path, limit=100)
    found = by_id(out)
    for d, t in TEXT.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert (found[d]["n_bytes"], found[d]["n_tokens"], found[d]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert out.count() == len(ROWS)
    stored = spark.read.parquet(cache).count()
    assert stored == len({(t or "") for _, t, *_ in ROWS})
    token_counts.token_counts(docs, cache, path).count()
    assert spark.read.parquet(cache).count() == stored  # nothing is encoded twice
    assert token_counts.token_counts(nothing, str(tmp_path / "empty"), path).count() == 0


def test_language_id(spark, nothing):
    rng = random.Random(1)
    stems = {"en": ["the", "ing", "tion", "ered"], "fr": ["eau", "que", "ment", "é"], "de": ["sch", "ung", "keit", "ü"]}
    rows = []
    for i in range(300):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(2)) for _ in range(30)), lang if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None), (1003, "日本", None)]
    found = by_id(language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    held = [(i, i % 3) for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] for i, _ in held) and len(held) > 30
    assert sum(found[i]["lang_pred"] == ["en", "fr", "de"][k] for i, k in held) >= 0.95 * len(held)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] in stems and 0 <= found[1003]["score"] <= 1
    assert language_id.identify_languages(nothing).count() == 0


def test_jaccard_components(docs, nothing):
    sets = {}
    for d, t in TEXT.items():
        w = words_of(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {d: (found[d]["n_shingles"], found[d]["component_id"]) for d in sets} == {d: (len(sets[d]), find(d)) for d in sets}
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_chains_through_a_hub(spark):
    """Copies that are alike only through the original still form one component, split over several groups."""
    rng = random.Random(2)
    hub = [f"h{i}" for i in range(300)]
    rows = [(1000, " ".join(hub))]
    for i in range(150):
        w = list(hub)
        for at in rng.sample(range(300), 4):
            w[at] = f"n{i}_{at}"
        rows.append((i, " ".join(w)))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {d: {tuple(w[i : i + 5]) for i in range(296)} for d, t in rows for w in [t.split(" ")]}
    hub_linked = {d for d in sets if 100 * len(sets[d] & sets[1000]) >= 80 * len(sets[d] | sets[1000])}
    assert len(hub_linked) > 100
    assert {r["component_id"] for r in out if r["doc_id"] in hub_linked} == {min(hub_linked)}


def test_weak_quality(docs, nothing):
    rows = weak_quality.weak_quality(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert weak_quality.weak_quality(nothing).count() == 0


def test_label_model_finds_the_better_labeller():
    rng = random.Random(3)
    accuracy = [0.95, 0.9, 0.9, 0.55, 0.85, 0.8, 0.8, 0.6, 0.9, 0.7]
    patterns, truth = Counter(), []
    for _ in range(4000):
        y = rng.random() < 0.7
        patterns["".join("0" if rng.random() < 0.2 else "+" if (rng.random() < a) == y else "-" for a in accuracy)] += 1
        truth.append(y)
    _, found = weak_quality.label_model([*patterns], [*patterns.values()])
    assert abs(found[0] - 0.95) < 0.04 and found[3] < 0.65


def test_exact_dedup(docs, nothing, spark):
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in TEXT.items()}
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    for counters in (4096, 1):
        found = by_id(exact_dedup.exact_dedup(docs, counters))
        for d, key in norm.items():
            keep = min(groups[key])[3]
            assert (found[d]["keep_id"], found[d]["group_size"], found[d]["kept"], found[d]["text_sha256"]) == (keep, len(groups[key]), keep == d, hashlib.sha256(key.encode()).hexdigest())
    assert exact_dedup.exact_dedup(nothing).count() == 0
    twice = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, "ab", 0)], "doc_id long, text string, _kept_id int")
    assert [(r["doc_id"], r["text"]) for r in exact_dedup.without_copies(twice).collect()] == [(1, "a b")]


def test_sentencepiece_round_trip(docs, nothing):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    found = by_id(sentencepieces.piece_digests(docs, path))
    for d, t in TEXT.items():
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert found[d]["n_tokens"] == len(ids)
        assert found[d]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepieces.piece_digests(nothing, path).count() == 0
    own = sentencepieces.PieceCoder(path)
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("abc the in▁ \n=-#é日🙂") for _ in range(rng.randint(0, 30)))
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids)


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, shards=5).collect()
    assert len(rows) == len(ROWS) and {r["law"] for r in rows} == {"rows"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all((found[d]["size"], found[d]["text_crc32"]) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in TEXT.items())
    assert sharding.shard(nothing).count() == 0


def test_communication_matrix_is_exact_and_uniform():
    counts = [7, 0, 12, 30, 1]
    total = np.zeros((5, 4))
    for seed in range(300):
        m = sharding.communication_matrix(counts, 4, seed)
        assert m.sum(axis=1).tolist() == counts and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1 and (m >= 0).all()
        total += m
    assert np.allclose(total[3] / 300, [7.8, 7.5, 7.5, 7.2], atol=0.4)
    rng = np.random.default_rng(1)
    drawn = [sharding.hypergeometric(rng, 600_000_000, 600_000_000, 1000) for _ in range(300)]
    assert abs(np.mean(drawn) - 500) < 5 and abs(np.std(drawn) - 15.8) < 3


def test_packing(docs, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = token_counts.load_tokenizer(path)
    rows = packing.best_fit_packing(docs, path).collect()
    pieces = defaultdict(dict)
    for r in rows:
        if r["doc_id"] is not None:
            pieces[r["doc_id"]][r["piece"]] = r
    for d, t in TEXT.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part, r = ids[lo : lo + 2048], pieces[d][k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (lo, len(part), zlib.crc32(part.tobytes()))
        assert len(pieces[d]) == -(-len(ids) // 2048)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.best_fit_packing(nothing, path).count() == 0


def test_bin_completion_beats_or_meets_best_fit():
    from dossier.llm.bin_completion import best_fit, lower_bound, pack

    rng = np.random.default_rng(7)
    for cap, sizes in ((10, [6, 5, 4, 3, 2]), (100, rng.integers(1, 100, 300)), (100, rng.integers(25, 45, 200)), (8, [])):
        counts = np.bincount(np.array(sizes, int), minlength=cap + 1)
        found = pack(counts, cap)
        back = np.zeros_like(counts)
        for content, times in found:
            assert sum(s * k for s, k in content) <= cap
            for s, k in content:
                back[s] += k * times
        assert (back == counts).all()
        n = sum(t for _, t in found)
        assert lower_bound(counts, cap) <= n <= sum(t for _, t in best_fit(counts, cap))


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(d, int("#" not in (t or "")), 0) for d, t in TEXT.items()], "doc_id long, quality int, toxic int")
    found = by_id(quality_rules.quality_rules(docs, labels))
    for d, t in TEXT.items():
        w = words_of(t)
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = [0] * len(w)
        for i in range(len(w) - 2):
            if triples[tuple(w[i : i + 3])] > 1:
                cover[i : i + 3] = [1, 1, 1]
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = found[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, sum(cover))
        failed = len(w) < 50 or 100 * sum(cover) > 50 * len(w)
        assert r["base_failed"] == failed and (not r["kept"] or not failed)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.quality_rules(docs, none).collect())
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert quality_rules.only_quality(docs, none).columns == docs.columns

"""Languages of texts of a few bytes at any batch size; weak labels where a doc_id has several texts."""

import random

import numpy as np

from dossier.llm import language_id as li
from dossier.llm import weak_quality as wq

WORDS = {"en": ["the", "of", "water", "ring", "with"], "de": ["der", "und", "straße", "nicht", "schön"], "fr": ["le", "où", "été", "garçon", "dans"]}


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def fitted():
    rng = random.Random(1)
    rows = [(lang, prose(lang, rng.randint(1, 30), rng)) for lang in WORDS for _ in range(150)]
    bags = [li.bag(t) for _, t in rows]
    return li.fit([x for x, _ in rows], [b for b, _ in bags], [s for _, s in bags])


def plain_buckets(text):
    """Subwords of 2 to 4 bytes without a gap inside and not of gaps alone, each at its bucket, one by one."""
    raw = [int(li.FOLD[b]) for b in text.encode()]
    out = []
    for i in range(len(raw)):
        for n in (2, 3, 4):
            part = raw[i : i + n]
            if len(part) < n or 32 in part[1:-1] or part == [32, 32]:
                continue
            code = (part[0] * 0x9E3779B1 ^ part[1] * 0x85EBCA6B) & 0xFFFFFFFF
            for k, factor in ((2, 0xC2B2AE35), (3, 0x165667B1)):
                if k < n:
                    code = ((code * 0x27D4EB2F) ^ (part[k] * factor)) & 0xFFFFFFFF
            code = ((code * 0x27D4EB2F) ^ (n * 0x01000193)) & 0xFFFFFFFF
            out.append(((code * 0x9E3779B1) & 0xFFFFFFFF) >> 16)
    return out


def test_scores_equal_a_plain_mean_of_embeddings():
    model, rng = fitted(), random.Random(2)
    texts = ["", "a", "ab", "abc", "é", "aé", " a", "a ", " ab ", "the", "der", "où", "x y", "\n\n", "  "]
    texts += [prose(lang, rng.randint(1, 9), rng) for lang in WORDS for _ in range(20)]
    expected = []
    for t in texts:
        found = plain_buckets(t)
        expected.append(model.scores[found].astype(float).mean(axis=0) + model.bias if found else model.bias)
        buckets, shares = li.bag(t)
        assert sorted(set(found)) == buckets.tolist()
        assert np.allclose(shares, [found.count(b) / len(found) for b in buckets])
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert np.allclose(model.logits(raw, offsets), expected)


def test_a_row_has_one_answer_at_any_batch_size():
    model, rng = fitted(), random.Random(3)
    texts = ["ab", "abc", "a", "", "é", "où", "der", "the"] + [prose("de", 5, rng) for _ in range(5)]
    alone = [model.predict(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    for _ in range(20):
        order = rng.sample(range(len(texts)), rng.randint(1, len(texts)))
        some = [texts[i] for i in order]
        best, p = model.predict(np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in some)]))
        for k, i in enumerate(order):
            assert best[k] == alone[i][0][0] and abs(p[k] - alone[i][1][0]) < 1e-9


def test_short_texts_are_learned_from(spark):
    rows = [(i, ["no", "ja", "oui"][i % 3], ["en", "de", "fr"][i % 3]) for i in range(600)]
    got = li.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()
    assert {(r["doc_id"] % 3, r["lang_pred"]) for r in got} == {(0, "en"), (1, "de"), (2, "fr")}


def test_every_text_of_a_doc_id_has_its_own_label(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(300):
        good = ". ".join(" ".join(rng.choice(["river", "stone", "tree", "cloud"]) + str(rng.randint(0, 99)) for _ in range(9)) for _ in range(12)) + "."
        bad = " ".join(rng.choice(["BUY$$$", "NOW!!!", "||CLICK||", "###"]) for _ in range(40))
        rows += [(i, good), (i, bad), (i, good)]
    taken = {}

    def keep(targets, buckets, values, train=wq.train):
        taken["targets"], taken["buckets"] = targets, buckets
        return train(targets, buckets, values)

    monkeypatch.setattr(wq, "train", keep)
    found = wq.weak_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(taken["targets"]) == 600  # a text that repeats under its doc_id counts once
    assert ((taken["targets"] > 0.5) == [len(b) > 80 for b in taken["buckets"]]).all()
    votes = {r["votes"]: r["posterior"] for r in found}
    assert sorted(taken["targets"]) == sorted(votes[v] for v in _first_votes(rows))
    assert len(found) == 900 and sum(r["kept"] for r in found) == 600


def _first_votes(rows):
    from dossier.llm.text_stats import text_stats

    for t in dict.fromkeys(rows):
        raw = np.frombuffer(t[1].encode(), np.uint8)
        yield "".join("-0+"[v + 1] for v in wq.votes(text_stats(raw, np.array([0, len(raw)])))[0])

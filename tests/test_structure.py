"""Structured chunks, taxonomy values of groups, selection in rounds and artifacts, against plain versions and awkward rows."""

import json
import random
import time

import pytest

from dossier.operators import chunking as C
from dossier.operators import elements as K
from dossier.operators import selection as Z
from dossier.operators import taxonomy_context as X
from dossier.sources import files as S


def plain_chunks(elements, most):
    """Greedy packing, an element at a time, as it would be done by hand."""
    out, path, open_ = [], [], None
    for place, kind, level, text, page in elements:
        words = K.WORD.findall(text or "")
        if not words:
            continue
        if kind == "heading":
            path = [p for p in path if p[0] < level] + [(level, text)]
            open_ = None
            continue
        rows = text.split("\n")
        if len(words) <= most:
            parts = [(text, len(words))]
        elif kind == "table":
            parts, head = [], len(K.WORD.findall(rows[0]))
            now, n = [], 0
            for r in rows[1:]:
                size = len(K.WORD.findall(r))
                if now and head + n + size > most:
                    parts.append(("\n".join([rows[0], *now]), head + n))
                    now, n = [], 0
                now.append(r)
                n += size
            parts.append(("\n".join([rows[0], *now]), head + n))
        else:
            parts = [(" ".join(words[i : i + most]), len(words[i : i + most])) for i in range(0, len(words), most)]
        for part, n in parts:
            if open_ is None or open_["n"] + n > most:
                open_ = {"texts": [], "n": 0, "path": [t for _, t in path], "pages": [], "places": []}
                out.append(open_)
            open_["texts"].append(part)
            open_["n"] += n
            open_["pages"].append(page)
            open_["places"] = sorted({*open_["places"], place})
    pages = lambda c, f: f([p for p in c["pages"] if p is not None], default=None)
    return [("\n".join(c["texts"]), c["n"], c["path"], pages(c, min), pages(c, max), c["places"]) for c in out]


def test_chunks_follow_the_structure(spark):
    rng, docs = random.Random(4), {}
    text = lambda n: " ".join(f"w{rng.randint(0, 50)}" for _ in range(n))
    for d in range(25):
        docs[f"d{d}"] = found = []
        for place in range(1, rng.randint(2, 60)):
            kind = rng.choice(["heading", "paragraph", "paragraph", "list", "table"])
            body = "\n".join(text(rng.randint(1, 6)) for _ in range(rng.randint(2, 12))) if kind == "table" else text(rng.choice((0, 1, 4, 9, 70)))
            found.append((place, kind, rng.randint(1, 3), body, rng.choice((None, place // 5))))
    docs["none"], docs["blank"] = [(1, "heading", 1, "Only a title", 1)], [(1, "paragraph", None, None, None), (2, "paragraph", 0, " \t", 1)]
    rows = [(d, *e) for d, es in docs.items() for e in es]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, K.ELEMENTS).repartition(5)
    for most in (1, 12, 40):
        got = {}
        for r in K.chunk_elements(frame, most).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"], r["token_count"], r["headings"], r["page_start"], r["page_end"], r["places"]))
        for d, es in docs.items():
            assert [x[1:] for x in sorted(got.get(d, []))] == plain_chunks(es, most), (d, most)
            assert [x[0] for x in sorted(got.get(d, []))] == list(range(len(got.get(d, []))))
    assert K.chunk_elements(frame.limit(0), 5).count() == 0


def test_subword_budget(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    counter = K.SubwordCounter(tokenizers.path("word_bpe_49k.json"))
    rows = [("a", i, "paragraph", 0, "supercalifragilistic words about heat recovery steam generators " * 3, 1) for i in range(6)]
    found = K.chunk_elements(spark.createDataFrame(rows, K.ELEMENTS), 40, counter).collect()
    assert all(r["token_count"] <= 40 for r in found) and sum(r["token_count"] for r in found) == sum(counter.counts([r[4] for r in rows]))


def test_elements_of_a_page(spark):
    html = "<html><head><title>T x</title><style>p{}</style><script>var a='<p>';</script></head><body><h1>One &amp; all</h1><p>first<br>line<p>second <b>bold</b><ul><li>a</li><li>b c</li></ul><h2>Two</h2><table><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td><p>2</p></td></tr></table>tail"
    rows = spark.createDataFrame([("p", html), ("q", None), ("r", "<p"), ("s", "plain")], "id string, html string")
    found = sorted((r["doc_id"], r["place"], r["kind"], r["level"], r["text"]) for r in K.page_elements(rows, "id", "html").collect())
    assert [f[2:] for f in found if f[0] == "p"] == [
        ("paragraph", 0, "T x"), ("heading", 1, "One & all"), ("paragraph", 0, "first line"), ("paragraph", 0, "second bold"), ("list", 0, "a"), ("list", 0, "b c"), ("heading", 2, "Two"), ("table", 0, "H1 | H2\n1 | 2"), ("paragraph", 0, "tail"),
    ]
    assert [f[4] for f in found if f[0] == "s"] == ["plain"] and not [f for f in found if f[0] == "q"]


def test_long_documents_take_linear_time():
    def took(n):
        text = "\n".join(["one two three"] * n)
        began = time.process_time()
        assert sum(c[1] for c in C.packed(C.paragraph_pieces(text, 64), 64)) == 3 * n
        return time.process_time() - began

    took(1000)
    small, large = took(40_000), took(400_000)
    assert large < 40 * max(small, 0.02)


def test_taxonomy_equals_the_joined_text(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "&", "x-y", ""]
    aliases = [("a", "one"), ("b c", "two"), ("c.b", "two other"), ("a b c d", "four"), ("d and a", "and"), ("zz", "never")]
    rows = [(rng.choice(["g1", "g2", None]) if i % 3 else "hot", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), rng.choice(words + [None])) for i in range(400)]
    rows += [("lone", 1000, None, None), ("late", 5, "a", ""), ("late", 4, "d &", None)]
    known = X.Aliases.of(aliases)
    for chosen in (rows, [r for r in rows if r[1] % 37 == 0 or r[1] >= 1000], []):
        joined = {}
        for g, _, t, u in sorted(chosen, key=lambda r: r[1]):
            joined.setdefault(g, []).extend(X.words_of(f"{t or ''} | {u or ''}"))
        expected = {g: (known.values + ["none"])[min(known.best(w), len(known.values))] for g, w in joined.items()}
        frame = spark.createDataFrame(chosen, "g string, at int, t string, u string").repartition(6)
        assert {r["g"]: r["value"] for r in X.forced_values(frame, ["g"], "at", ["t", "u"], aliases, "none").collect()} == expected


def test_parts_join_like_text():
    rng = random.Random(8)
    known = X.Aliases.of([("a b a", "1"), ("b b", "2"), ("a a b b a", "3"), ("c", "4")])
    for _ in range(300):
        words = [rng.choice("abbac"[: rng.randint(2, 5)]) for _ in range(rng.randint(0, 14))]
        cuts = sorted(rng.randint(0, len(words)) for _ in range(rng.randint(0, 5)))
        parts = [X.Part.of(words[lo:hi], known) for lo, hi in zip([0, *cuts], [*cuts, len(words)], strict=True)]
        while len(parts) > 1:  # in any grouping
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].joined(parts[i + 1], known)]
        assert parts[0] == X.Part.of(words, known)


def test_rounds_go_on_and_end_in_errors(spark, tmp_path):
    tasks = spark.createDataFrame([(i, None if i == 4 else "s", "c", ["a", "b"], p) for i, p in enumerate(["ok", "late", "bad", "ok 2", "ok 3", None])], "id int, scope string, chunk_id string, candidates array<string>, payload string")
    folder, waits = str(tmp_path / "r"), []

    class Flaky:  # travels to the workers by value
        def __init__(self, attempt):
            self.attempt = attempt

        def judge(self, payloads):
            if self.attempt < 3 and any("late" in p for p in payloads):
                raise TimeoutError("slow")
            return ['{"selected_doc_ids": ["b", "a", "b"]}' if "ok" in p or "late" in p else "null" for p in payloads]

    judge = Flaky
    first = Z.selected_in_rounds(tasks, ["id"], judge, folder, delay=2.0, rounds=1, sleep=waits.append)
    assert {r["id"]: r["error"] for r in first.collect()} == {0: None, 1: "TimeoutError: slow", 2: "no list of selected_doc_ids", 3: None, 4: None, 5: "no list of selected_doc_ids"} and waits == []
    done = Z.selected_in_rounds(tasks, ["id"], judge, folder, delay=2.0, sleep=waits.append)
    found = {r["id"]: (r["attempt"], r["selected"], r["error"]) for r in done.collect()}
    assert found[0] == (1, ["b", "a"], None) and found[1] == (3, ["b", "a"], None) and found[2] == (3, None, "no list of selected_doc_ids") and waits == [2.0, 4.0]
    files = spark.read.parquet(folder).count()
    again = Z.selected_in_rounds(tasks, ["id"], judge, folder, delay=2.0, sleep=waits.append)
    assert again.count() == 6 and spark.read.parquet(folder).count() == files and len(waits) == 2


def test_answers_are_checked(spark):
    from pyspark.sql import functions as F

    answers = ['{"selected_doc_ids": ["a"]}', '```json\n{"selected_doc_ids": [], "chunk_id": "c"}\n```', '{"selected_doc_ids": ["x", "a"]}', '{"selected_doc_ids": ["a"], "chunk_id": "d"}', "{}", "text", None, json.dumps({"selected_doc_ids": "a"})]
    rows = spark.createDataFrame([(i, a, None) for i, a in enumerate(answers)] + [(9, None, "busy")], "i int, a string, f string")
    got = {r[0]: r[1] for r in rows.select("i", Z.answer_error(F.col("a"), F.col("f"), F.array(F.lit("a"), F.lit("b")), F.lit("c"))).collect()}
    assert got == {0: None, 1: None, 2: "unknown ids: x", 3: "answer of another chunk", 4: "no list of selected_doc_ids", 5: "no JSON", 6: "no JSON", 7: "no list of selected_doc_ids", 9: "busy"}


def test_artifacts_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "output_match_1.csv").write_text('Document,Chunk ID,Matched_Doc_2,Matched_Doc_1,Matched_Doc_1_Doc_ID\n"two\nlines, one",c1,second," ",id1\nd,c2,,,\n', encoding="utf-8-sig")
    (tmp_path / "output_match_2.csv").write_text("Chunk ID,Matched_Doc_131,Note\nc9,far,n\nshort\n")
    (tmp_path / "output_match_3.csv").write_text("")
    (tmp_path / "other.csv").write_text("Chunk ID,Matched_Doc_1\nx,y\n")
    found = sorted((r["path"].rsplit("/", 1)[1], r["row"], r["document"], r["chunk_id"], r["rank"], r["doc_id"], r["display"]) for r in S.match_artifacts(spark, str(tmp_path)).collect())
    assert found == [("output_match_1.csv", 1, "two\nlines, one", "c1", 1, "id1", None), ("output_match_1.csv", 1, "two\nlines, one", "c1", 2, None, "second"), ("output_match_2.csv", 1, None, "c9", 131, None, "far")]

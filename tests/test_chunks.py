"""The bound on chunks."""

import pytest

from dossier.operators import chunking as K


def test_no_chunk_exceeds_the_budget(spark):
    words = [f"w{i}" for i in range(20_000)]
    long = " ".join(words)
    rows = [(1, long), (2, "a b\n" + " ".join(words[:25]) + "\nc d\n\ne"), (3, " ".join(words[:10])), (4, " ".join(words[:11])), (5, None), (6, "a  b\nc")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = K.chunk_paragraphs(df, "doc_id", "text", 10).orderBy("doc_id", "chunk_index").collect()
    assert max(len(r["text"].split()) for r in out) == max(r["token_count"] for r in out) == 10
    assert all(len(r["text"].split()) == r["token_count"] for r in out)
    for d, text in rows:
        mine = [r for r in out if r["doc_id"] == d]
        assert [r["chunk_index"] for r in mine] == list(range(len(mine)))
        assert " ".join(r["text"] for r in mine).split() == (text or "").split()
    texts = {d: [r["text"] for r in out if r["doc_id"] == d] for d, _ in rows}
    assert [len(t) for t in texts.values()] == [2000, 4, 1, 2, 0, 1]
    assert texts[2] == ["a b", " ".join(words[:10]), " ".join(words[10:20]), " ".join(words[20:25]) + "\nc d\ne"] and texts[6] == ["a  b\nc"]
    assert max(r["token_count"] for r in K.chunk_paragraphs(df, "doc_id", "text").collect()) == K.MOST_TOKENS
    with pytest.raises(ValueError):
        K.chunk_paragraphs(df, "doc_id", "text", 0)

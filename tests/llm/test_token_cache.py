"""The digest cache where one doc_id has several texts."""

from dossier.llm import token_counts
from dossier.llm.token_counts import tokenizer_path


def test_two_texts_under_one_doc_id(spark, tmp_path):
    path, cache = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    size = lambda t: len(token_counts.load_tokenizer(path).encode(t, add_special_tokens=False))
    short, long = "one", "a much longer text of several words " * 4
    docs = spark.createDataFrame([(1, short), (1, long), (1, short), (2, short), (None, long)], "doc_id long, text string")
    want = sorted([size(short)] * 3 + [size(long)] * 2)
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(docs, cache, path).collect()) == want
    # what the first call stored also serves later calls
    again = spark.createDataFrame([(7, short), (8, long)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(again, cache, path).collect()} == {7: size(short), 8: size(long)}

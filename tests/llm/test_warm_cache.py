"""A warm cache: nothing is encoded again, and no text leaves the map side."""

from dossier.llm import token_counts as tc


def test_only_misses_leave_the_map_side(spark, tmp_path, monkeypatch):
    rows = [(i % 40 if i % 9 else None, ["one two", None, "", f"text {i} of its own", "x" * 5000][i % 5]) for i in range(300)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tc.tokenizer_path("byte_bpe_50k.json")
    kept = spark.sparkContext.accumulator(0)

    def counted(missing, among=tc._among):
        def run(batches):
            for batch in among(missing)(batches):
                kept.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(tc, "_among", counted)
    cache, first = str(tmp_path / "c"), None
    for texts, most in ((docs, 180), (docs, 0), (docs.union(spark.createDataFrame([(7, "quite new")], docs.schema)), 4)):
        before = kept.value
        found = sorted(map(str, tc.token_counts(texts, cache, path).collect()))
        assert kept.value - before <= most
        first = first or found
        assert set(first) <= set(found)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1


def test_counts_of_a_digest_under_several_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "c"), (2, "a b"), (None, "c"), (None, "d d d"), (None, "d d d")]
    found = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "c"), tc.tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found) == [(0, 1, 1), (0, 5, 3), (0, 5, 3), (1, 1, 1), (1, 3, 2), (2, 3, 2)]

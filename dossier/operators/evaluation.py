"""Retrieval, selection and project-level metrics against judged pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELEVANT = 3


def checked_qrels(qrels: DataFrame, keys: list[str], relevance: str = "relevance") -> tuple[DataFrame, DataFrame]:
    """(one row a key with relevance clamped to 0..3, keys whose rows disagree)."""
    found = qrels.withColumn(relevance, F.greatest(F.lit(0), F.least(F.lit(3), F.col(relevance))))
    grouped = found.groupBy(*keys).agg(F.min(relevance).alias(relevance), F.max(relevance).alias("_most"))
    return grouped.filter(F.col(relevance) == F.col("_most")).drop("_most"), grouped.filter(F.col(relevance) != F.col("_most")).select(*keys)


def recall_at_k(qrels: DataFrame, ranking: DataFrame, k: int, least: int = RELEVANT) -> DataFrame:
    """(query_id, positives, hits, recall, hit_rate) over all queries of either side; null metrics without positives."""
    positive = qrels.filter(F.col("relevance") >= least).select("query_id", "doc_id").distinct()
    top = ranking.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    per = positive.join(top, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("positives"), F.count("hit").alias("hits"))
    every = qrels.select("query_id").union(ranking.select("query_id")).distinct()
    out = every.join(per, "query_id", "left").fillna(0, ["positives", "hits"])
    rate = lambda x: F.when(F.col("positives") > 0, x)
    return out.withColumns({"recall": rate(F.round(F.col("hits") / F.col("positives"), 6)), "hit_rate": rate((F.col("hits") > 0).cast("double"))})


def recall_of_classes(items: DataFrame, ranking: DataFrame, label: str, k: int) -> DataFrame:
    """recall_at_k where every other item of a query's class is a positive: classes are counted, pairs are never made.

    items: doc_id and the label; queries are items, too.
    """
    sizes = items.groupBy(label).agg((F.count(F.lit(1)) - 1).alias("positives"))
    asked = ranking.select("query_id").distinct().join(items.withColumnRenamed("doc_id", "query_id"), "query_id").join(sizes, label)
    top = ranking.filter((F.col("rank") <= k) & (F.col("query_id") != F.col("doc_id"))).select("query_id", "doc_id").join(items.select("doc_id", F.col(label).alias("_other")), "doc_id")
    hits = top.join(asked.select("query_id", label), "query_id").groupBy("query_id").agg(F.count_if(F.col(label) == F.col("_other")).alias("hits"))
    out = asked.select("query_id", "positives").join(hits, "query_id", "left").fillna(0, ["hits"])
    some = F.col("positives") > 0
    return out.withColumns({"recall": F.when(some, F.round(F.col("hits") / F.col("positives"), 6)), "hit_rate": F.when(some, (F.col("hits") > 0).cast("int").cast("double"))})


def metric_summary(per_query: DataFrame) -> DataFrame:
    """Queries, those with positives, and means that leave nulls out."""
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.count("recall").alias("positive_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("hit_rate"), 6).alias("mean_hit_rate"))


def set_scores(truth: Column, predicted: Column, empty_prediction_is_right: bool = False) -> dict[str, Column]:
    """Precision, recall, F1 and the lists behind them.

    An empty prediction against a non-empty truth has no precision, or precision
    1 with empty_prediction_is_right; two empty sets are perfect.
    """
    both, n_truth, n_pred = F.size(F.array_intersect(truth, predicted)), F.size(truth), F.size(predicted)
    blank = F.lit(1.0) if empty_prediction_is_right else F.when(n_truth > 0, F.lit(None).cast("double")).otherwise(1.0)
    precision = F.when(n_pred == 0, blank).otherwise(both / n_pred)
    recall = F.when(n_truth == 0, F.lit(1.0) if empty_prediction_is_right else F.lit(None).cast("double")).otherwise(both / n_truth)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when((precision + recall) == 0, 0.0)
    return {
        "n_hit": both, "precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6),
        "missing": F.array_sort(F.array_except(truth, predicted)), "unexpected": F.array_sort(F.array_except(predicted, truth)),
    }


def grouped_sets(df: DataFrame, by: list[str], item: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(name))


def set_metrics(truth: DataFrame, predicted: DataFrame, by: list[str], item: str, empty_prediction_is_right: bool = False) -> DataFrame:
    """set_scores of each group of either side."""
    both = grouped_sets(truth, by, item, "truth").join(grouped_sets(predicted, by, item, "predicted"), by, "full_outer")
    nothing = F.array().cast("array<bigint>") if dict(truth.dtypes)[item] == "bigint" else F.array().cast("array<string>")
    both = both.withColumns({c: F.coalesce(c, nothing) for c in ("truth", "predicted")})
    return both.select(*by, F.size("truth").alias("n_truth"), F.size("predicted").alias("n_predicted"), *[v.alias(k) for k, v in set_scores(F.col("truth"), F.col("predicted"), empty_prediction_is_right).items()])


def document_rollup(selected: DataFrame, scope: str, doc: str, chunk: str, rank: str, shown: Sequence[str] = ()) -> DataFrame:
    """Per (scope, doc): distinct evidence chunks, best rank and the `shown` texts (the first of each), ordered within the scope.

    Most evidence comes first, then the best rank (none or none above 0 last),
    then the shown texts, such as number and title, then the document.
    """
    from dossier.functions.columns import ranked, text_or_blank

    usable = F.when(F.col(rank) > 0, F.col(rank))
    per = selected.groupBy(scope, doc).agg(F.array_sort(F.collect_set(chunk)).alias("evidence"), F.min(usable).alias("best_rank"), *[F.min(F.trim(text_or_blank(c))).alias(c) for c in shown])
    per = per.withColumn("n_evidence", F.size("evidence"))
    return per.withColumn("position", ranked([scope], F.desc("n_evidence"), F.asc_nulls_last("best_rank"), *[F.asc(c) for c in shown], F.asc(doc)))


def verified(judged: DataFrame, verifier: DataFrame, keys: list[str], level: int = RELEVANT) -> DataFrame:
    """Judgments that a verifier agrees with, both at full relevance."""
    both = judged.join(verifier.select(*keys, F.col("relevance").alias("verifier_relevance"), "agrees"), keys)
    return both.filter(F.col("agrees") & (F.col("relevance") == level) & (F.col("verifier_relevance") == level))


def first_of_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row of each key, the earliest."""
    from dossier.functions.columns import ranked

    return rows.withColumn("_r", ranked(keys, F.asc(position))).filter("_r = 1").drop("_r")


def split_stratified(rows: DataFrame, strata: list[str], unique: str, share: float, seed: int) -> DataFrame:
    """Seeded train/dev split: max(1, round(n * share)) dev rows of each stratum, never all; singletons train."""
    from pyspark.sql import Window

    from dossier.functions.columns import ranked

    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    dev = F.least(F.greatest(F.lit(1), F.bround(n * share, 0).cast("int")), n - 1)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unique).cast("string")))
    return rows.withColumns({"_n": dev, "_r": ranked(strata, order, F.col(unique))}).withColumn("split", F.when(F.col("_r") <= F.col("_n"), "dev").otherwise("train")).drop("_n", "_r")


def explode_evidence(rows: DataFrame, chunks: str, as_name: str = "chunk_id") -> DataFrame:
    return rows.withColumn(as_name, F.explode(F.split(F.col(chunks), "\\|")))

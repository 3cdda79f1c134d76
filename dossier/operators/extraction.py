"""Model extraction over chunks and over grouped rows: payloads in, JSON answers by id out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import bounded_int, without_fence
from dossier.operators.listing import numbered, with_group
from dossier.operators.providers import Judge, judge_rows

MOST_ITEMS = 20
LEAST_CONFIDENCE = 70


def extracted(chunks: DataFrame, provider: Judge, schema: str, payload: str = "payload", name: str = "found") -> DataFrame:
    """chunks with the struct a model gave for their payload, and failed where it gave none that parses."""
    told = judge_rows(chunks, payload, provider, "_answer")
    told = told.withColumn("_answer", without_fence("_answer")).withColumn("failed", F.get_json_object("_answer", "$").isNull())
    return told.withColumn(name, F.when(~F.col("failed"), F.from_json("_answer", schema))).drop("_answer")


def needs_second_look(confidence: Column, flagged: Column, failed: Column) -> Column:
    """Low confidence, a flag of the model itself, or no usable answer."""
    return failed | F.coalesce(flagged, F.lit(False)) | (bounded_int(confidence.cast("string"), 0, 100) < LEAST_CONFIDENCE)


def verified_extraction(rows: DataFrame, asked: Column, verifier: Judge, payload: str = "payload", name: str = "verdict") -> DataFrame:
    """rows with a second model's answer for those asked about; the others have none."""
    rows = rows.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    told = judge_rows(rows.filter("_asked"), payload, verifier, name)
    return told.unionByName(rows.filter("not _asked").withColumn(name, F.lit(None).cast("string"))).drop("_asked")


def _in_batches(rows: DataFrame, by: Sequence[str], key: str, most: int) -> DataFrame:
    """rows with a number of their own (_no) and their batch; those of a batch have consecutive numbers in order of _n."""
    # numbered over all groups in ranges, then from each group's first: no group is sorted by one task
    placed = numbered(rows, [*[F.asc(b) for b in by], F.asc(key)], "_no")
    placed = with_group(placed, placed.groupBy(*by).agg(F.min("_no").alias("_first")), by).withColumn("_n", F.col("_no") - F.col("_first"))
    return placed.withColumn("batch", F.floor(F.col("_n") / most).cast("int")).drop("_first")


def _payloads(placed: DataFrame, by: Sequence[str], key: str, item: Column) -> DataFrame:
    """(by, batch, _from, keys, payload), _from being the number of a batch's first row."""
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(key).alias("id"), item.alias("item"))))
    out = placed.groupBy(*by, "batch").agg(listed.alias("_l"), F.min("_no").alias("_from"))
    shown = F.to_json(F.transform("_l", lambda x: F.struct(x["id"].alias("id"), x["item"].alias("item"))))
    return out.select(*by, "batch", "_from", F.transform("_l", lambda x: x["id"]).alias("keys"), shown.alias("payload"))


def grouped_payloads(rows: DataFrame, by: Sequence[str], key: str, item: Column, most: int = MOST_ITEMS) -> DataFrame:
    """(by, batch, keys, payload): the items of a group in order of their key, `most` at a time, as one JSON list each."""
    by = list(by)
    return _payloads(_in_batches(rows, by, key, most), by, key, item).drop("_from")


def answers_of_groups(rows: DataFrame, by: Sequence[str], key: str, item: Column, provider: Judge, answer: str, most: int = MOST_ITEMS) -> DataFrame:
    """rows with the model's answer (a struct of fields `answer`, id among them) and answered.

    An answer belongs to the batch that was asked: ids that it didn't ask about
    are dropped, the first answer to an id counts, and a row without one stays
    with nulls. Rows of one id in one batch take its answers in their order, and
    the first where there are no more.
    """
    by = list(by)
    placed = _in_batches(rows, by, key, most)
    told = judge_rows(_payloads(placed, by, key, item), "payload", provider, "_answer").withColumn("_list", F.from_json(without_fence("_answer"), f"array<struct<{answer}>>"))
    each = told.select("_from", "keys", "_list", F.posexplode("keys").alias("_at", "_id"))
    mine = F.filter("_list", lambda a: a["id"] == F.col("_id"))
    before = F.size(F.filter("keys", lambda k, i: (k == F.col("_id")) & (i < F.col("_at"))))
    each = each.withColumns({"_mine": mine, "_before": before}).select((F.col("_from") + F.col("_at")).alias("_no"), F.coalesce(F.get("_mine", F.col("_before")), F.get("_mine", F.lit(0))).alias("answer"))
    return placed.drop("_n", "batch").join(each, "_no", "left").drop("_no").withColumn("answered", F.col("answer").isNotNull())

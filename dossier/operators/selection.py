"""Model selection in rounds: what failed or answered wrongly is asked again, and only that.

Each round asks the rows that no round before has settled, checks every answer,
and appends its rows (keys, attempt, answer, error) to a folder before the next
one begins. A run that is broken off goes on with the rows and attempts that are
missing. After the last round what is still wrong is an error row of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.columns import ranked
from dossier.functions.text import without_fence
from dossier.operators.providers import Judge, bounded_batches

ATTEMPTS = 3
ANSWER = "selected_doc_ids array<string>, chunk_id string"


def answered_or_failed(judge: Judge, payloads: Sequence[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each payload; a batch that fails is halved until the failing item stands alone."""
    try:
        out = list(judge.judge(payloads))
        if len(out) != len(payloads):
            raise ValueError(f"{len(out)} answers to {len(payloads)} payloads")
        return [(a, None) for a in out]
    except Exception as e:
        if len(payloads) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(payloads) // 2
        return answered_or_failed(judge, payloads[:half]) + answered_or_failed(judge, payloads[half:])


def _ask(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).fill_null("").to_pylist()
            found = [x for lo, hi in bounded_batches(payloads) for x in answered_or_failed(judge, payloads[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]], ["_key", "answer", "failure"])

    return run


def answer_error(answer: Column, failure: Column, candidates: Column, chunk: Column) -> Column:
    """Why an answer doesn't stand; null where it does: JSON with a list of ids, of the row's own chunk, out of its own candidates."""
    plain = without_fence(answer)
    told = F.from_json(plain, ANSWER)
    strange = F.array_except(told["selected_doc_ids"], candidates)
    return (
        F.when(failure.isNotNull(), failure).when(F.get_json_object(plain, "$").isNull(), "no JSON").when(told["selected_doc_ids"].isNull(), "no list of selected_doc_ids")
        .when(F.coalesce(told["chunk_id"], F.lit("")).isin("") | (told["chunk_id"] == chunk), F.when(F.size(strange) > 0, F.concat(F.lit("unknown ids: "), F.array_join(strange, ","))))
        .otherwise("answer of another chunk")
    )


def _rounds(spark: SparkSession, folder: str, keys: str) -> DataFrame:
    schema = f"{keys}, attempt int, selected array<string>, error string"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:  # no round yet
        return spark.createDataFrame([], schema)


def selected_in_rounds(tasks: DataFrame, keys: Sequence[str], judge: Callable[[int], Judge], folder: str, attempts: int = ATTEMPTS, delay: float = 0.0, rounds: int | None = None, sleep=time.sleep) -> DataFrame:
    """(keys, attempt, selected, error): each task's valid answer, or its last error after `attempts`.

    tasks: keys, chunk_id, candidates (ids) and payload. judge gives the provider
    of an attempt. Before round n the run waits delay * (n - 1) seconds. `rounds`
    ends a run early; the next one goes on from the folder.
    """
    spark, keys = tasks.sparkSession, list(keys)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.schema.fields if f.name in keys)
    key = F.to_json(F.struct(*keys))
    for attempt in range(1, attempts + 1):
        if rounds is not None and attempt > rounds:
            break
        done = _rounds(spark, folder, shape).filter(F.col("error").isNull() | (F.col("attempt") >= attempt)).select(*keys).distinct()
        pending = tasks.join(done, keys, "left_anti")
        if pending.isEmpty():
            continue
        if attempt > 1 and delay:
            sleep(delay * (attempt - 1))
        asked = pending.withColumn("_key", key)
        told = asked.select("_key", "payload").mapInArrow(_ask(judge(attempt)), "_key string, answer string, failure string")
        both = asked.join(told, "_key").withColumn("error", answer_error(F.col("answer"), F.col("failure"), F.col("candidates"), F.col("chunk_id")))
        selected = F.when(F.col("error").isNull(), F.array_distinct(F.from_json(without_fence("answer"), ANSWER)["selected_doc_ids"]))
        both.select(*keys, F.lit(attempt).alias("attempt"), selected.alias("selected"), "error").write.mode("append").parquet(folder)
    last = ranked(keys, F.col("error").isNull().cast("int").desc(), F.desc("attempt"))
    return _rounds(spark, folder, shape).withColumn("_r", last).filter("_r = 1").drop("_r")

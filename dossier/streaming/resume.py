"""Incremental runs: new keys only, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def pending(rows: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows if done is None else rows.join(done.select(*keys).distinct(), keys, "left_anti")


def finished(rows: DataFrame, folder: str) -> DataFrame | None:
    """What earlier runs wrote to the folder, if anything."""
    try:
        return rows.sparkSession.read.parquet(folder)
    except AnalysisException:
        return None


def resume(rows: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, keys: list[str]) -> DataFrame:
    """Apply work to pending rows, append its result, return all results."""
    work(pending(rows, finished(rows, folder), keys)).write.mode("append").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def resume_stream(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """The same over a stream: each micro-batch drops repeats and keys already written.

    A micro-batch that runs twice after a failure appends nothing new, since its
    keys are then in the folder: results are exactly once.
    """

    def each(batch: DataFrame, _: int) -> None:
        work(pending(batch.dropDuplicates(keys), finished(batch, folder), keys)).write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

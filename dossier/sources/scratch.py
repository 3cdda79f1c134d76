"""Folders for files that a query writes and reads again, and results that later steps share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where the driver runs all tasks itself."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return shared.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder: later steps read it, however often their plans name it, and a lost executor costs nothing before it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

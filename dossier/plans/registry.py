"""Named queries over the driver tables and their DuckDB equivalents.

A plan module registers each query with `@query(sql)`; the function takes a
`Tables` reader and returns a DataFrame whose columns are named as in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "bm25_topk"
MODULES = ("retrieval", "wording", "scheduling", "matching", "listing", "evaluation", "reporting", "ingestion", "registers", "audit", "cases", "records", "schedule", "extraction", "stored", "structure", "matchrun")


class Tables:
    """The tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(make: Callable[[Tables], DataFrame]):
        name = make.__name__
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return make

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"dossier.plans.{name}")

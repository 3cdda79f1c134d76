"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows are hashed to units. The driver draws, unit by unit, how many of its rows
each shard gets: multivariate hypergeometric against the capacity that is left,
so each shard ends at its exact size (units x shards numbers; a unit has up to
5 million rows, so 10^11 rows are 20,000 units). A unit permutes its rows by a keyed hash and deals them out by those
counts; after the exchange each shard permutes again, in hashed blocks with
exact offsets, so no task ever holds a shard.

Defined results: law `rows`, counts at most one apart. A null text has size 8
and CRC 0. Rows without doc_id and texts of any length are rows as any other.
Rows are dealt by their number in the written table, so repeated rows
are dealt independently and no two keys tie. A uniform deal with exact sizes
parts equal texts: groups of equal texts are not kept together. Extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.frames import documents, settled

SHARDS = 24
#: A unit holds UNIT_ROWS rows; beyond MANY_UNITS units they grow to LARGE_UNIT_ROWS before there are more of them.
UNIT_ROWS = 50_000
LARGE_UNIT_ROWS = 5_000_000
MANY_UNITS = 4096
LEAST_UNITS = 64
_NUMPY_LIMIT = 900_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows are good; beyond numpy's range by inverting the log-gamma form around the mode."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mean = drawn * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * (total - drawn) / (total - 1)))
    lo, hi = max(0, drawn - bad, int(mean - 12 * sd)), min(good, drawn, int(mean + 12 * sd) + 1)
    k = np.arange(lo, hi)
    ratio = np.log((good - k) * (drawn - k).astype(float)) - np.log((k + 1.0) * (bad - drawn + k + 1.0))
    log_mass = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(log_mass - log_mass.max()))
    return lo + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def communication_matrix(unit_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sum to the units' counts, columns to shard sizes that are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(unit_rows)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = np.zeros((len(unit_rows), shards), np.int64)
    for i, n in enumerate(unit_rows):
        pool = sum(left)
        for j in range(shards):
            pool -= left[j]
            out[i, j] = hypergeometric(rng, left[j], pool, n)
            n -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 20_240_501, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))  # written once: the numbers stay
    total = rows.count()
    unit_rows = max(unit_rows, min(LARGE_UNIT_ROWS, total // MANY_UNITS))
    units = max(LEAST_UNITS, -(-total // unit_rows))
    blocks = max(4, -(-total // (shards * unit_rows)))
    key = lambda salt: F.xxhash64(F.lit(seed + salt), "row")
    rows = rows.withColumns({"first_key": key(1), "second_key": key(2)})
    rows = rows.withColumns({"unit": F.pmod(key(0), F.lit(units)).cast("int"), "block": F.pmod(F.shiftrightunsigned("second_key", 20), F.lit(blocks)).cast("int")})
    counted = sorted((r["unit"], r["n"]) for r in rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a unit: 20,000 for 10^11 rows
    matrix = np.cumsum(communication_matrix([n for _, n in counted], shards, seed), axis=1)
    dealt = spark.createDataFrame([(u, [int(x) for x in row]) for (u, _), row in zip(counted, matrix, strict=True)], "unit int, upto array<long>")

    local = F.row_number().over(Window.partitionBy("unit").orderBy("first_key", "row"))
    placed = (
        rows.withColumn("r", local)
        .join(F.broadcast(dealt), "unit")
        .withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("r"))))
        .drop("upto", "r", "unit", "first_key")
    )
    placed = settled(placed)
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))  # about a row a unit
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "block", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "block").orderBy("second_key", "row"))
    return (
        placed.withColumn("inner", inner)
        .join(F.broadcast(offsets), ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
            (F.col("before") + F.col("inner") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))

"""Exact dedup by a heavy-hitter split.

Every text is reduced to the SHA-256 of its bytes without white space, in the
JVM. A Misra-Gries summary per task finds digests that hold more than 1/(k+1) of
the rows; at most k of them exist. Their groups are aggregated exactly
(verified), the winners are broadcast and those rows are settled on the map
side. All other digests go through an ordinary shuffle, where no key can be hot
any more.

Defined results: a null text counts as empty, so null, empty and blank texts
are one group. One row of each group is kept: most code points, then smallest
doc_id (null last), then smallest text digest; of rows that are alike in all of
these, the first in the order read. Extra columns are carried by without_copies
and not read otherwise, whatever their names. Texts of any length pass as they
are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.frames import documents, settled

HEAVY_COUNTERS = 4096
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _order(text: Column, doc_id: Column) -> Column:
    """What decides within a group, smallest first."""
    return F.struct(
        (-F.length(F.coalesce(text, F.lit("")))).cast("long").alias("points"), doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"), F.xxhash64(text).alias("as_written")
    )


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, rank) of each row; rank decides within a digest, its last field the row's number as written."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), _digest(F.col("text")).alias("digest"), _order(F.col("text"), doc_id).withField("row", F.monotonically_increasing_id()).alias("rank"))


def misra_gries(counters: int):
    """Arrow mapper: a key column to (key, lower bound of its count in this task), `counters` keys at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in batch.column(0).value_counts():
                key = item["values"].as_py()
                held[key] = held.get(key, 0) + item["counts"].as_py()
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "least"])

    return run


def heavy_digests(rows: DataFrame, total: int, counters: int = HEAVY_COUNTERS) -> DataFrame:
    """Digests whose summed lower bounds exceed total/(counters+1): fewer than counters+1 rows by that very bound."""
    found = rows.select("digest").mapInArrow(misra_gries(counters), "digest binary, least long")
    return found.groupBy("digest").agg(F.sum("least").alias("least")).filter(F.col("least") * (counters + 1) > total).select("digest")


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))


def heavy_winners(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, best, group_size) of the digests that are heavy, `counters` rows at most."""
    heavy = F.broadcast(heavy_digests(rows, rows.count(), counters))
    return settled(_winners(rows.join(heavy, "digest", "left_semi")))


def exact_dedup(docs: DataFrame, counters: int = HEAVY_COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    rows = settled(text_digests(docs))
    marked = rows.join(F.broadcast(heavy_winners(rows, counters)), "digest", "left")
    rest = marked.filter("group_size is null").select("digest", "doc_id", "rank")
    columns = ["doc_id", "rank", "best", "group_size", "digest"]
    resolved = marked.filter("group_size is not null").select(*columns).union(rest.join(_winners(rest), "digest").select(*columns))
    return resolved.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rank.row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, counters: int = HEAVY_COUNTERS) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps.

    Rows of heavy digests that their broadcast winner beats go on the map side.
    The others meet once, by digest; each task sends one row of a digest at most.
    """
    digest, rank, best, place = (free_name(docs, n) for n in ("digest", "rank", "best", "place"))
    doc_id = F.col("doc_id").cast("long")
    heavy = heavy_winners(settled(text_digests(docs)), counters)
    # rows are read anew here, so they are matched by all of the rank but its row number
    known = heavy.select(F.col("digest").alias(f"{digest}_"), F.col("best").dropFields("row").alias(best))
    marked = docs.withColumns({digest: _digest(F.col("text")), rank: _order(F.col("text"), doc_id)})
    left = marked.join(F.broadcast(known), F.col(digest) == F.col(f"{digest}_"), "left").filter(F.col(best).isNull() | (F.col(best) == F.col(rank)))
    order = Window.partitionBy(digest).orderBy(rank)
    one = left.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return one.select(*(f"`{c}`" for c in docs.columns))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df and its derived columns don't use."""
    while any(c.lower().startswith(f"_{name}") for c in df.columns):
        name = f"x{name}"
    return f"_{name}"


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS pts
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW g AS (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM w
"""

"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.frames import removed, settled, written

#: A vertex with more than 1/HUB_SHARE of all edges, and HUB_EDGES at least, has its edges dealt over SALTS tasks.
HUB_SHARE = 1024
HUB_EDGES = 32
SALTS = 64
#: Rounds of plain spreading before labels also jump, which only long chains need.
PLAIN_ROUNDS = 4


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex in edges (a, b); component is the smallest id that links reach.

    Labels spread along edges as per-vertex minima, combined before the shuffle.
    Where a few rounds don't settle them, each label also jumps to its label's
    own label, which shortens chains to their logarithm. Every round is written
    to the shared folder, the round before it removed. Edges of a hub are dealt
    out by a salt that its label is repeated for; a graph has fewer than
    HUB_SHARE hubs.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    degrees = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))
    degrees = settled(degrees)
    hubs = degrees.filter(F.col("n") > max(HUB_EDGES, both.count() // HUB_SHARE)).select(F.col("a").alias("hub"))
    salted = not hubs.isEmpty()
    if salted:
        hubs = F.broadcast(settled(hubs))
        salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).cast("int")
        both = settled(both.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", salt.alias("salt")))
    labels, rounds, used = degrees.select(F.col("a").alias("id"), F.least("a", "least").alias("component")), 0, []
    while True:
        told = _told(both, labels, hubs if salted else None).select(F.col("b").alias("id"), "component", F.lit(None).cast("long").alias("was"))
        heard = labels.withColumn("was", F.col("component")).unionByName(told)
        nearer, path = written(heard.groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was")))
        for old in used:
            removed(edges.sparkSession, old)
        used, rounds = [path], rounds + 1
        if nearer.filter("component <> was").isEmpty():
            out = settled(nearer.select("id", "component"))
            removed(edges.sparkSession, path)
            return out
        labels = nearer.select("id", "component")
        if rounds >= PLAIN_ROUNDS:
            labels, path = written(_jumped(nearer))
            used.append(path)


def _told(both: DataFrame, labels: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """(b, component): what each edge's first end tells its second."""
    if hubs is None:
        return both.join(labels, both["a"] == labels["id"]).select("b", "component")
    salts = F.sequence(F.lit(0), F.when(F.col("hub").isNotNull(), SALTS - 1).otherwise(0))
    dealt = labels.join(hubs, F.col("id") == F.col("hub"), "left").select("id", "component", F.explode(salts).alias("place"))
    return both.join(dealt, (both["a"] == dealt["id"]) & (both["salt"] == dealt["place"])).select("b", "component")


def _jumped(nearer: DataFrame) -> DataFrame:
    """Labels moved to their label's own label; a label is asked for once, and its answer dealt to its members by a salt."""
    asked = nearer.select("component").distinct()
    roots = nearer.select(F.col("id").alias("root"), F.col("component").alias("above")).filter("above < root")
    answers = asked.join(roots, asked["component"] == roots["root"]).select("root", "above", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("place"))
    members = nearer.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    found = members.join(answers, (F.col("component") == F.col("root")) & (F.col("salt") == F.col("place")), "left")
    return found.select("id", F.least("component", "above").alias("component"))

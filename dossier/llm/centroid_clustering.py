"""Lloyd's centroid clustering in exact integers, by kd-tree filtering.

Vectors are quantised to integers. Each task puts its vectors into blocks of
BLOCK and builds a kd-tree of each (kd_tree.py); the trees are written once to
the shared folder. A round sends the centroids to all tasks, and each task sends
back one count and one sum for every centroid and component: whole nodes give
theirs unopened, leaves are resolved point by point. Spark adds them up; the
driver gets centroids x components numbers. A last pass labels every vector.

Seeds are the kept vectors with the smallest SHA-256 of `<seed>:<vec_id>`; equal
hashes go by the vector itself.

Defined results: a vector is kept if it has exactly the stated number of
components, none null or non-finite; others have no row. A kept vector without
vec_id is clustered and never a seed. Repeated rows are vectors of their own, as
seeds too. Fewer kept vectors than centroids give as many centroids. A centroid
without vectors stays where it is. Equal distances go to the smaller number.
Components beyond 2^25 after scaling raise an error, as distances would leave 64
bits. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.frames import documents, settled, written
from dossier.llm.kd_tree import LARGEST, KdTree, distances

SCALE = 1024
DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BLOCK = 4096
_PARTS = ("begin", "end", "child", "low", "high", "sums")
TREES = "ids array<long>, points binary, " + ", ".join(f"`{x}` binary" for x in _PARTS)


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point array<double> of whole numbers) of the vectors that are kept."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))  # noqa: E731  NaN is greater than all others
    kept = vectors.filter((F.size(x) == dimensions) & F.forall(x, finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("point"))


def _points(column: pa.Array, dimensions: int) -> np.ndarray:
    found = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if np.abs(found).max(initial=0) > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST} after scaling: squared distances would leave 64 bits")
    return found.astype(np.int64)


def _grow(dimensions: int):
    def tree(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        built, order = KdTree.build(np.concatenate(points))
        names = pa.concat_arrays(ids).take(pa.array(order))
        columns = [pa.array([names.to_pylist()], pa.list_(pa.int64())), pa.array([built.points.astype(np.int32).tobytes()])]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([getattr(built, x).tobytes()]) for x in _PARTS]], ["ids", "points", *_PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            found = _points(batch.column(1), dimensions)
            lo = 0
            while lo < len(found):
                hi = min(len(found), lo + BLOCK - n)
                ids.append(batch.column(0).slice(lo, hi - lo))
                points.append(found[lo:hi])
                n, lo = n + hi - lo, hi
                if n == BLOCK:
                    yield tree(ids, points)
                    ids, points, n = [], [], 0
        if n:
            yield tree(ids, points)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, KdTree]]:
    for batch in batches:
        for i in range(len(batch)):
            raw = {x: np.frombuffer(batch.column(x)[i].as_buffer(), np.int64) for x in _PARTS}
            wide = {x: raw[x].reshape(-1, dimensions) if x in ("low", "high", "sums") else raw[x] for x in _PARTS}
            points = np.frombuffer(batch.column("points")[i].as_buffer(), np.int32).reshape(-1, dimensions).astype(np.int64)
            yield batch.column("ids")[i].values, KdTree(points, **wide)


def _sum_batches(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, tree in _trees(batches, centroids.shape[1]):
            n, s = tree.totals(centroids)
            count += n
            sums += s
        if count.any():
            k, width = centroids.shape
            columns = [np.repeat(np.arange(k), width), np.tile(np.arange(width), k), np.repeat(count, width), sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["cluster", "part", "n", "s"])

    return run


def _label_batches(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, centroids.shape[1]):
            label = tree.labels(centroids)
            far = distances(tree.points, centroids)[np.arange(len(label)), label]
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids; k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.filter("vec_id is not null").select(digest.alias("digest"), "point").orderBy("digest", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.float64).astype(np.int64)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; those without vectors stay."""
    parts = trees.mapInArrow(_sum_batches(centroids), "cluster int, part int, n long, s long")
    totals = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in totals.collect():  # centroids x components
        if r["n"]:
            out[r["cluster"], r["part"]] = int(r["s"]) // r["n"]
    return out


def centroid_clustering(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector, the centroids)."""
    points = quantised(vectors, dimensions, scale)
    trees, _ = written(points.mapInArrow(_grow(dimensions), TREES))
    centroids = seeds(points, k, seed).reshape(-1, dimensions)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    return trees.mapInArrow(_label_batches(centroids), "vec_id long, cluster int, distance long"), centroids


def with_inertia(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each row with the summed distances of its cluster and of all, and its centroid's digest; one row a cluster reaches the driver."""
    labelled = settled(labelled)
    total = {r["cluster"]: int(r["d"]) for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    if not total:
        return labelled.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in total}
    choose = lambda found, kind: F.element_at(F.create_map(*[F.lit(x) for c in sorted(found) for x in (c, found[c])]), F.col("cluster")).cast(kind)
    return labelled.select("vec_id", "cluster", "distance", choose(total, "long").alias("cluster_inertia"), F.lit(sum(total.values())).cast("long").alias("inertia"), choose(digest, "string").alias("centroid_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*centroid_clustering(documents(spark, sf_dir, "embeddings")))


def _rounds_sql() -> str:
    """Rounds as tables of (centroid, component, value), one after the other."""
    far = "SELECT v.rid, c.c, sum((v.q - c.q) * (v.q - c.q)) AS d FROM vectors v JOIN {} c USING (i) GROUP BY ALL"
    near = "SELECT rid, c, d FROM ({}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"
    out = []
    for k in range(ROUNDS):
        out.append(f"near{k} AS MATERIALIZED ({near.format(far.format(f'round{k}'))})")
        mean = f"SELECT n.c, v.i, sum(v.q) AS s, count(*) AS n FROM vectors v JOIN near{k} n USING (rid) GROUP BY ALL"
        floor = "CASE WHEN m.s >= 0 THEN m.s // m.n ELSE -((-m.s + m.n - 1) // m.n) END"
        out.append(f"round{k + 1} AS MATERIALIZED (SELECT o.c, o.i, CAST(coalesce({floor}, o.q) AS BIGINT) AS q FROM round{k} o LEFT JOIN ({mean}) m USING (c, i))")
    out.append(f"final AS MATERIALIZED ({near.format(far.format(f'round{ROUNDS}'))})")
    return ",\n".join(out)


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
vectors AS MATERIALIZED (
  SELECT rid, generate_subscripts(embedding, 1) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS q FROM kept),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),
round0 AS MATERIALIZED (SELECT s.c, v.i, v.q FROM seeds s JOIN vectors v USING (rid)),
{_rounds_sql()},
digests AS (SELECT c, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS digest FROM round{ROUNDS} GROUP BY c)
SELECT k.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(f.d) OVER () AS BIGINT) AS inertia, g.digest AS centroid_sha256
FROM final f JOIN kept k USING (rid) JOIN digests g USING (c)
"""

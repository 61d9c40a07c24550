"""Centroid clustering of integer vectors, exact: distances by the expansion |x|^2 - 2 x.c + |c|^2 in blocked float64 BLAS.

Vectors become rows of integers, are packed into blocks of ``BLOCK`` vectors and written once. Every round is a ``treeAggregate`` over
the blocks: a task adds whole-number sums and counts of its vectors by cluster, partial sums (a few numbers a cluster) meet in a tree, and the driver gets
one small table. A float64 product is exact while no sum in it can pass 2^53; a block for which the bound does not hold is done in Python's
integers. Sums are of Python's integers beyond a block, so no total overflows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, table, written

#: Components of a vector, the factor its components are multiplied by, clusters, rounds, and what ids are hashed with.
SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64.0, 16, 3, "1:"
#: Vectors of a block.
BLOCK = 4096
#: Whole numbers up to this are exact in float64.
EXACT = 1 << 53
_LONGEST = (1 << 63) - 1


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, embedding) with exactly ``size`` components, none of them null or not finite."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return vectors.select("vec_id", x).where((F.size(x) == size) & F.forall(x, finite))


def whole(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as integers: int64, or Python's where one is too large for it."""
    with np.errstate(over="ignore"):
        y = np.floor(np.asarray(x, np.float64) * scale)
    if y.size == 0 or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    # the product may have left the range of doubles, so it is taken of the exact fraction
    return np.array([[int(np.floor(v * scale)) if abs(v) < 1e300 else int(v) * int(scale) for v in row] for row in np.asarray(x, np.float64).tolist()], object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of integers; ties go to the smaller number."""
    size = x.shape[1]
    most = max(_most(x), _most(centroids))
    if 4 * size * most * most < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = np.einsum("ij,ij->i", a, a)[:, None] - 2.0 * (a @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
        cluster = d.argmin(1)
        return cluster, d[np.arange(len(d)), cluster].astype(np.int64)
    a, c = x.astype(object), centroids.astype(object)
    d = np.array([[sum((p - q) ** 2 for p, q in zip(row, other, strict=True)) for other in c.tolist()] for row in a.tolist()], object).reshape(len(a), len(c))
    cluster = np.array([min(range(len(c)), key=row.__getitem__) for row in d.tolist()], np.int64)
    return cluster, d[np.arange(len(d)), cluster]


def _most(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


class Totals:
    """Counts, sums of vectors and sums of distances by cluster, in Python's integers."""

    def __init__(self, clusters: int, size: int):
        self.count, self.distance = [0] * clusters, [0] * clusters
        self.sum = np.zeros((clusters, size), object)

    def add(self, x: np.ndarray, centroids: np.ndarray) -> Totals:
        cluster, distance = nearest(x, centroids)
        for k in np.unique(cluster).tolist():
            own = cluster == k
            # a block of int64 that small sums up without overflow
            part = x[own] if _most(x) < 1 << 48 else x[own].astype(object)
            self.count[k] += int(own.sum())
            self.sum[k] += part.sum(0).astype(object)
            self.distance[k] += sum(distance[own].tolist())
        return self

    def merge(self, other: Totals) -> Totals:
        self.count = [a + b for a, b in zip(self.count, other.count, strict=True)]
        self.distance = [a + b for a, b in zip(self.distance, other.distance, strict=True)]
        self.sum = self.sum + other.sum
        return self


def _matrix(batch: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    values = batch.column(name).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _packed(x: np.ndarray) -> tuple[bytes | None, list[str] | None]:
    return (x.tobytes(), None) if x.dtype == np.int64 else (None, [str(v) for v in x.ravel().tolist()])


def _unpacked(row, size: int) -> np.ndarray:
    if row.small is not None:
        return np.frombuffer(row.small, np.int64).reshape(-1, size)
    return np.array([int(v) for v in row.large], object).reshape(-1, size)


def blocks(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """Rows of up to BLOCK vectors: their integers as int64 bytes, or as decimal strings where they need more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, BLOCK):
                small, large = _packed(whole(_matrix(whole_batch.slice(start, BLOCK)), scale))
                yield pa.RecordBatch.from_arrays([pa.array([small], pa.binary()), pa.array([large], pa.list_(pa.string()))], names=["small", "large"])

    return arrow_map(vectors.select("embedding"), run, "small binary, large array<string>")


def seeds(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED, scale: float = SCALE) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; equal ids by their components. A null id is none."""
    key: Column = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(key.alias("_key"), "embedding").orderBy("_key", "embedding").limit(clusters).collect()
    return whole(np.array([r.embedding for r in rows], np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, scale: float = SCALE) -> tuple[np.ndarray, Totals | None]:
    """The centroids after so many rounds over kept vectors, and the totals of the assignment to them."""
    spark = vectors.sparkSession
    centroids = seeds(vectors, clusters, seed, scale)
    if not len(centroids):
        return centroids, None
    size = centroids.shape[1]
    rdd = written(blocks(vectors, scale), "centroid-blocks").rdd
    totals = None
    for done in range(rounds + 1):
        held = spark.sparkContext.broadcast(centroids)
        totals = rdd.treeAggregate(Totals(len(centroids), size), lambda t, row, held=held: t.add(_unpacked(row, size), held.value), lambda a, b: a.merge(b), 2)
        held.unpersist()
        if done < rounds:
            moved = [totals.sum[k] // totals.count[k] if totals.count[k] else centroids[k].astype(object) for k in range(len(centroids))]
            centroids = np.array(moved, object)
            centroids = centroids.astype(np.int64) if _most(centroids) < 1 << 62 else centroids
    return centroids, totals


SCHEMA = "vec_id long, cluster int, distance long"


def assigned(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: str = SEED, scale: float = SCALE) -> DataFrame:
    """Vectors (vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length or with a component that is null or not finite are left out. Rows of a null vec_id are
    assigned but never a first centroid; repeated rows count each; with fewer vectors than clusters there are as many clusters as vectors, with none no
    rows come out. A distance or inertia beyond a long is the largest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size)
    centroids, totals = fit(rows, clusters, rounds, seed, scale)
    if totals is None:
        return spark.createDataFrame([], SCHEMA + ", cluster_inertia long, inertia long, centroid_sha256 string")
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                cluster, distance = nearest(whole(_matrix(part), scale), held.value)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(cluster, pa.int32()), pa.array([min(v, _LONGEST) for v in distance.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(str(v) for v in c.tolist()).encode()).hexdigest() for c in centroids]
    return arrow_map(rows, run, SCHEMA).select(
        "vec_id", "cluster", "distance", of([min(v, _LONGEST) for v in totals.distance]).cast("long").alias("cluster_inertia"), F.lit(min(sum(totals.distance), _LONGEST)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256")
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [
        f"""v0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(e, lambda x: CAST(floor({SCALE:g} * x) AS BIGINT)) AS e FROM v0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT sha256('{SEED}' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {CLUSTERS}))""",
    ]
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, v.vec_id, v.e, c.k, {distance} AS d FROM v CROSS JOIN c{i} c) GROUP BY r, vec_id, e)")
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS MATERIALIZED (SELECT k, list(q ORDER BY j) AS e FROM (SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY k, j)) GROUP BY k)"""
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (k)"""


SQL = _sql()

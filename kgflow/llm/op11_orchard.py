"""Centroid clustering by Orchard's search, in whole numbers.

Every centroid has a list of the others by distance.  A vector walks along the list of the
centroid it is at; one that is closer takes over, and the walk goes on along that one's list.
Centroids met before are marked and skipped.  The walk stops strictly beyond twice the current
distance, where by the triangle inequality nothing as close can come, so the nearest centroid is
exact, ties included.  All vectors of a batch take each step together.

A round is one pass over the vectors: each task adds up the vectors of each centroid, Spark adds
up the tasks, and a row for each centroid, whose number is a parameter, goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import Scratch, lean, table

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SALT = 2
SCALE = 256
#: Whole-number components reach as far as this, so that squared distances are longs; those beyond count as this.
LARGEST = 1 << 26


def whole(vector: Column, dims: int) -> tuple[Column, Column]:
    """(whether a vector is kept, its whole-number components)."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.least(F.greatest(SCALE * x.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return vector.isNotNull() & (F.size(vector) == dims) & ~odd, F.transform(vector, lambda x: F.floor(scaled(x)).cast("int"))


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the others by distance, then number."""
    apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    ranked = apart.copy()
    np.fill_diagonal(ranked, -1)  # a centroid itself comes first, also before its equals
    return apart, np.argsort(ranked, axis=1, kind="stable")[:, 1:]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each point (of equal ones the smallest number), the squared distance, and the number of distances taken."""
    n, k = len(points), len(centroids)
    apart, lists = neighbours(centroids)
    at, step = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = ((points - centroids[0]) ** 2).sum(1)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    walking, taken = np.arange(n if k > 1 else 0), n
    while len(walking):
        near = lists[at[walking], step[walking]]
        within = apart[at[walking], near] <= 4 * best[walking]
        walking, near = walking[within], near[within]
        step[walking] += 1
        new = ~visited[walking, near]
        who, near = walking[new], near[new]
        visited[who, near] = True
        d = ((points[who] - centroids[near]) ** 2).sum(1)
        taken += len(who)
        closer = (d < best[who]) | ((d == best[who]) & (near < at[who]))
        who, near, d = who[closer], near[closer], d[closer]
        at[who], best[who], step[who] = near, d, 0
        walking = walking[step[walking] < k - 1]
    return at, best, taken


def _points(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("point").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """What each task's vectors add up to at each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            points = _points(batch, centroids.shape[1])
            at = nearest(points, centroids)[0]
            np.add.at(sums, at, points)
            count += np.bincount(at, minlength=len(count))
        held = np.flatnonzero(count)
        yield pa.record_batch([pa.array(held), pa.array(count[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance, _ = nearest(_points(batch, centroids.shape[1]), centroids)
            yield pa.record_batch([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def seeds(points: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors whose salted id has the smallest hash, in that order; of rows that share an id the smallest vectors."""
    hashed = points.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "point")
    return np.array([r.point for r in hashed.orderBy("hash", "point").limit(k).collect()], np.int64)


def refine(points: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after that many rounds of assigning all vectors and taking means, rounded down."""
    dims = centroids.shape[1]
    for _ in range(rounds):
        parts = points.mapInArrow(lean(_sums(centroids)), "cluster long, n long, sums array<long>")
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)]
        means = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
            means[r.cluster] = np.array(r[2:], np.int64) // r.n
        centroids = means
    return centroids


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: int = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster int, distance long for every kept vector; the final centroids).

    Kept are vectors of ``dims`` components, none null or non-finite; a component x counts as floor(256 * x), and as
    2**26 beyond that.  Rows that repeat an id are vectors of their own; one without an id is assigned but is no seed.
    Fewer than k kept vectors give as many centroids; a table without any gives no rows.  Other columns do not matter.
    The vectors are written once, as whole numbers, in a table that belongs to ``scratch``.
    """
    kept, point = whole(F.col(vector_col), dims)
    points = scratch.write(vectors.where(kept).select(F.col(id_col).cast("long").alias("vec_id"), point.alias("point")), "points")
    centroids = seeds(points, k, salt)
    if not len(centroids):
        return points.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance"), np.zeros((0, dims), np.int64)
    centroids = refine(points, centroids, rounds)
    return points.mapInArrow(lean(_assigned(centroids)), "vec_id long, cluster int, distance long"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"), scratch)
    assigned = scratch.write(assigned, "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    long = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("own"))
    whole_sum = inertia.agg(F.sum("own").alias("all"))
    stats = inertia.crossJoin(whole_sum).join(names, "cluster").select("cluster", long(F.col("own")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: int = SALT) -> str:
    square = "list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), p) - 1 AS c, p AS m FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(p) AS p, min(CAST({square} AS HUGEINT) * {k} + c) AS best FROM kept, c{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
                SELECT c, list(v ORDER BY i) AS m FROM (
                    SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
                    FROM (SELECT best % {k} AS c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance,
               CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c = best % {k}"""


SQL = _sql()

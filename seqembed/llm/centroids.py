"""Centroid clustering in exact integers, with most distances ruled out by rotated coordinates.

Components become integers, floor(scale * x). A rotation to the principal axes is fitted on at most `SAMPLE`
vectors, those first in the order of their hashed ids; the first of these are also the first centroids. Each
vector is stored once as its integers, its `LEAD` leading rotated coordinates and the length of what is left of
it. For a centroid, the squared distance of the leading coordinates plus the squared difference of the two
lengths is a lower bound of the squared distance. Each vector is first measured in integers against the centroid
of the smallest bound; only centroids whose bound, less an allowance for rounding, does not exceed that distance
are measured too. The rotation decides how much is ruled out, never the result.

A round reads the stored vectors once; every task adds up its own sums, and the driver sees one row per centroid
and dimension. Sums are decimals of 38 digits, so they are exact at any number of rows.

Vectors that are missing, have another length, or hold a null or non-finite component are left out. Rows of one
id are vectors of their own; first centroids with one hash are ordered by their integers, and rows without an id
come last. With fewer vectors than centroids there are that many centroids; an empty table gives no rows. Equal
distances go to the smaller centroid. Components beyond 2^27 after scaling raise, as their distances would not
fit in 64 bits. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import ship_package, stage

SAMPLE = 4096
LEAD = 8
LARGEST = 1 << 27
ALLOWANCE = 1e-10  # share of the squared lengths; rounding is below 1e-12 of them


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Principal axes of the rows of `sample`, as columns, the widest first."""
    centred = sample - sample.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


def rotated(points: np.ndarray, rotation: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the length of the remaining ones."""
    turned = points.astype(np.float64) @ rotation
    return turned[:, :lead], np.sqrt(np.square(turned[:, lead:]).sum(axis=1))


class _Rotate:
    """(id, integers) to (id, integers, leading coordinates, length of the rest)."""

    def __init__(self, rotation, lead: int):
        self.rotation, self.lead = rotation, lead

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = self.rotation.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1), len(rotation), np.int64)
            if (np.abs(points) > LARGEST).any():
                raise ValueError(f"a scaled component is beyond {LARGEST}")
            lead, rest = rotated(points, rotation, self.lead)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(rotation))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lead.shape[1])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(points.astype(np.int32).ravel())),
                pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest),
            ], names=["id", "point", "lead", "rest"])


class Centroids:
    """Integer centroids with their rotated coordinates."""

    def __init__(self, points: np.ndarray, rotation: np.ndarray, lead: int):
        self.points = points
        self.lead, self.rest = rotated(points, rotation, lead)
        self.squares = np.square(self.lead).sum(axis=1) + self.rest ** 2

    def nearest(self, points: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row, and how many distances were measured."""
        rows = np.arange(len(points))
        bound = np.stack([np.square(lead - c).sum(axis=1) + (rest - r) ** 2 for c, r in zip(self.lead, self.rest)], axis=1)
        squares = np.square(lead).sum(axis=1) + rest ** 2
        bound -= ALLOWANCE * (squares[:, None] + self.squares)
        cluster = bound.argmin(axis=1)
        distance = np.square(points - self.points[cluster]).sum(axis=1)
        survives = bound <= distance[:, None]
        survives[rows, cluster] = False
        for number in range(len(self.points)):
            at = np.flatnonzero(survives[:, number])
            measured = np.square(points[at] - self.points[number]).sum(axis=1)
            better = (measured < distance[at]) | ((measured == distance[at]) & (number < cluster[at]))
            distance[at[better]], cluster[at[better]] = measured[better], number
        return cluster, distance, len(points) + int(survives.sum())


class _Sums:
    """Stored vectors to one row per centroid that a task met: (cluster, vectors, sums of components)."""

    def __init__(self, state):
        self.state = state

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = self.state.value
        k, width = state.points.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(0), width, np.int64)
            cluster, _, _ = state.nearest(points, _matrix(batch.column(1), state.lead.shape[1], np.float64),
                                          batch.column(2).to_numpy())
            counts += np.bincount(cluster, minlength=k)
            for number in range(k):
                sums[number] += points[cluster == number].sum(axis=0)
        met = np.flatnonzero(counts)
        if len(met):
            offsets = pa.array(np.arange(len(met) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([
                pa.array(met.astype(np.int32)), pa.array(counts[met]),
                pa.ListArray.from_arrays(offsets, pa.array(sums[met].ravel()))], names=["cluster", "n", "sums"])


class _Assign:
    """Stored vectors with their ids to (id, cluster, distance)."""

    def __init__(self, state):
        self.state = state

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = self.state.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance, _ = state.nearest(
                _matrix(batch.column(1), state.points.shape[1], np.int64),
                _matrix(batch.column(2), state.lead.shape[1], np.float64), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["id", "cluster", "distance"])


def scaled(vectors: DataFrame, size: int, scale: int, id_column: str, vector: str) -> DataFrame:
    """`(id, point)`: the integers of the vectors of `size` finite components."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731 (NaN is above infinity)
    kept = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter(
        (F.size("v") == size) & F.forall("v", finite))
    return kept.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("point"))


def _moved(stored: DataFrame, state: Centroids) -> np.ndarray:
    """Floors of the means of each centroid's vectors; a centroid without any stays."""
    spark = stored.sparkSession
    sums = stored.select("point", "lead", "rest").mapInArrow(
        _Sums(spark.sparkContext.broadcast(state)), "cluster int, n long, sums array<long>")
    cells = sums.select("cluster", "n", F.posexplode("sums").alias("at", "total")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    points = state.points.copy()
    for row in cells.collect():  # centroids times dimensions
        points[row.cluster, row["at"]] = int(row.total) // row.n
    return points


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024,
            id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """`(id, cluster, distance)` of every kept vector after `rounds` rounds, staged, and the integer centroids."""
    spark = vectors.sparkSession
    ship_package(spark)
    points = scaled(vectors, size, scale, id_column, vector)
    hashed = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "point")
    sample = np.array([r.point for r in hashed.orderBy(F.asc_nulls_last("hash"), "point").limit(max(SAMPLE, k)).collect()],
                      np.int64).reshape(-1, size)
    out = T.StructType([T.StructField("id", points.schema["id"].dataType), T.StructField("cluster", T.IntegerType()),
                        T.StructField("distance", T.LongType())])
    if not len(sample):
        return spark.createDataFrame([], out), sample
    rotation = rotation_of(np.clip(sample, -LARGEST, LARGEST).astype(np.float64))
    lead = min(LEAD, size)
    schema = T.StructType([points.schema["id"], T.StructField("point", T.ArrayType(T.IntegerType())),
                           T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])
    stored = stage(points.mapInArrow(_Rotate(spark.sparkContext.broadcast(rotation), lead), schema), "centroid-points")
    state = Centroids(sample[:k], rotation, lead)
    for _ in range(rounds):
        state = Centroids(_moved(stored, state), rotation, lead)
    assigned = stored.mapInArrow(_Assign(spark.sparkContext.broadcast(state)), out)
    return stage(assigned, "centroid-assigned"), state.points


def report(vectors: DataFrame, **options) -> DataFrame:
    """Cluster, distance and sums of distances of every kept vector, with a digest of its centroid."""
    spark: SparkSession = vectors.sparkSession
    assigned, points = cluster(vectors, **options)
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(whole.alias("total")).collect()}  # one row per centroid
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    totals = spark.createDataFrame([(c, n, sum(sums.values()), digests[c]) for c, n in sums.items()],
                                   "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def report_sql(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The same for DuckDB, one pair of table expressions per round."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, p) - 1 AS c, p
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, p FROM v) ORDER BY c LIMIT {k})"""]
    nearest = """
a{n} AS MATERIALIZED (
  SELECT i, any_value(vec_id) AS vec_id, any_value(p) AS p, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT i, vec_id, v.p AS p, c,
               list_sum(list_transform(list_zip(v.p, c{n}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM (SELECT row_number() OVER () AS i, vec_id, p FROM v) AS v, c{n})
  GROUP BY i)"""
    moved = """
m{n} AS (
  SELECT c, j, sum(x) AS s, count(*) AS n
  FROM (SELECT best.c AS c, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM a{n}) GROUP BY c, j),
c{next} AS MATERIALIZED (
  SELECT c{n}.c AS c, coalesce(new.p, c{n}.p) AS p
  FROM c{n} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS p FROM m{n} GROUP BY c) AS new USING (c))"""
    for n in range(rounds):
        steps += [nearest.format(n=n), moved.format(n=n, next=n + 1)]
    steps.append(nearest.format(n=rounds))
    return ",".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.p, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""

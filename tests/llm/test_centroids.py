"""Clustering against a plain version in Python integers, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from seqembed.llm import centroids
from seqembed.llm.queries import SQL, op12_rotated_centroids

TYPES = "vec_id long, embedding array<double>, cluster string, ID int, point int"


def plain(rows, k=8, rounds=10, size=64):
    """(vec_id, cluster, distance, centroid) of each kept vector."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]

    def order(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centres = [p for _, p in sorted(kept, key=order)[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, p in kept:
            members.setdefault(nearest(p)[1], []).append(p)
        centres = [tuple(sum(x) // len(members[n]) for x in zip(*members[n])) if n in members else c
                   for n, c in enumerate(centres)]
    return [(i, nearest(p)[1], nearest(p)[0], centres[nearest(p)[1]]) for i, p in kept]


def check(spark, rows):
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], TYPES)
    got = centroids.report(table).collect()
    expected = plain(rows)
    by_cluster = {}
    for _, c, d, _ in expected:
        by_cluster[c] = by_cluster.get(c, 0) + d
    wanted = [(i, c, d, by_cluster[c], sum(by_cluster.values()),
               hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for i, c, d, centre in expected]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_plain_version_with_ties_nulls_and_copies(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) * (j < 3) for j in range(64)]) for i in range(150)]  # many ties
    rows += [(1000 + i, [draw.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(150)]
    rows += [(2000 + i, [0.25] * 64) for i in range(60)] + [(7, [0.25] * 64)] * 5
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 65), (3004, [None] + [1.0] * 63),
             (3005, [float("nan")] + [1.0] * 63), (3006, [float("-inf")] + [1.0] * 63), (None, [0.1] * 64), (None, [-3.3] * 64)]
    check(spark, rows)


def test_large_components(spark):
    draw = random.Random(2)
    check(spark, [(i, [draw.uniform(-10_000, 10_000) for _ in range(64)]) for i in range(80)])
    far = spark.createDataFrame([(1, [200_000.0] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.report(far).collect()


def test_few_and_none(spark):
    check(spark, [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.5] * 64)])
    check(spark, [(1, None)])
    assert centroids.report(spark.createDataFrame([], TYPES)).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_rule_out_and_never_change_the_result():
    draw = np.random.default_rng(4)
    points = draw.integers(-5000, 5000, (20, 64))[draw.integers(0, 20, 3000)] + draw.integers(-300, 300, (3000, 64))
    rotation = centroids.rotation_of(points[:500].astype(np.float64))
    state = centroids.Centroids(points[:20], rotation, centroids.LEAD)
    cluster, distance, measured = state.nearest(points, *centroids.rotated(points, rotation, centroids.LEAD))
    exact = np.square(points[:, None] - state.points).sum(axis=2)
    assert (distance == exact.min(axis=1)).all() and (cluster == exact.argmin(axis=1)).all()
    assert measured < 0.5 * exact.size


def test_embeddings_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = db.execute(SQL["op12_rotated_centroids"]).fetchall()
    got = [tuple(row) for row in op12_rotated_centroids(spark, folder).collect()]
    assert sorted(got) == sorted(expected)

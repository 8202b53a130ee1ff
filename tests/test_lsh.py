import numpy as np
import pytest
from pyspark.sql import functions as F

from seqembed.operators import lsh
from seqembed.operators.lsh import knn_lsh, knn_lsh_recall
from test_neighbors import brute_force, found, frame


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16))
    rows = centres[np.arange(1500) % 30] + 0.15 * draw.normal(size=(1500, 16))
    return np.concatenate([rows, np.repeat(rows[:1], 200, axis=0), np.zeros((2, 16))]).astype(np.float32)


def share(got, want):
    return sum(len(set(got.get(i, [])) & set(near)) for i, near in want.items()) / sum(map(len, want.values()))


def test_finds_most_and_ranks_exactly(spark, clustered):
    got = knn_lsh(frame(spark, clustered), 10, bucket_rows=100)
    want = brute_force(clustered, 10)
    near = found(got)
    assert share(near, want) >= 0.9
    assert set(near) <= set(want)
    units = clustered[:1700].astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for row in got.filter("vec_id < 50").collect():
        assert abs(row.cosine - units[row.vec_id] @ units[row.neighbor]) < 1e-9


def test_one_group_of_near_copies(spark):
    """A third of the rows in one tight cluster: units stay bounded, and near rows meet."""
    draw = np.random.default_rng(2)
    tight = draw.normal(size=(1, 8)) + 0.001 * draw.normal(size=(700, 8))
    matrix = np.concatenate([tight, draw.normal(size=(300, 8))]).astype(np.float32)
    nodes = lsh.prepared(frame(spark, matrix), "vec_id", "embedding")[1]
    planes = lsh.planes_for(nodes, 1000, 5, 0.95, 50, 0)
    signed = nodes.select("rep", "vector").mapInArrow(lsh._Sign(spark.sparkContext.broadcast(planes)),
                                                      "rep string, keys array<long>, sides array<double>")
    units = lsh._units(signed, 50)
    assert units.groupBy("table", "key", "part").count().agg(F.max("count")).first()[0] <= 100
    assert share(found(knn_lsh(frame(spark, matrix), 5, bucket_rows=50)), brute_force(matrix, 5)) >= 0.8


def test_ties_copies_and_edges(spark):
    same = np.ones((30, 3), np.float32)
    assert found(knn_lsh(frame(spark, same), 4)) == brute_force(same, 4)
    none = frame(spark, np.zeros((3, 2), np.float32))
    assert knn_lsh(none, 2).count() == 0 and knn_lsh(none.limit(0), 2).count() == 0
    assert knn_lsh_recall(none, 2).count() == 0
    one = frame(spark, np.ones((1, 2), np.float32))
    assert knn_lsh(one, 2).count() == 0 and knn_lsh_recall(one, 2).count() == 0
    few = frame(spark, np.array([[1, 0], [1, 1], [0, 2]], np.float32))
    assert {len(near) for near in found(knn_lsh(few, 15)).values()} <= {1, 2}


def test_recall_of_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = knn_lsh_recall(rows).collect()
    assert len(got) == rows.filter("vec_id % 100 = 0").count()
    assert all(r.n_exact == 15 and r.recall >= 0.9 for r in got)
    matrix = np.array([r.embedding for r in rows.orderBy("vec_id").collect()])
    assert share(found(knn_lsh(rows)), brute_force(matrix, 15)) >= 0.9


def test_no_step_over_all_pairs(spark, clustered):
    plan = knn_lsh(frame(spark, clustered), 5, bucket_rows=100)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

import numpy as np
import pytest
from pyspark.sql import types as T

from seqembed.operators.neighbors import knn_cosine
from seqembed.operators.projection import pca_2d

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], SCHEMA)


def brute_force(matrix, k):
    units = matrix.astype(float)
    lengths = np.linalg.norm(units, axis=1)
    usable = np.flatnonzero(lengths > 0)
    units = units[usable] / lengths[usable, None]
    sims = np.round(units @ units.T, 12)
    np.fill_diagonal(sims, -9)
    return {int(i): [int(usable[j]) for j in np.lexsort((usable, -row))[:k] if row[j] > -9]
            for i, row in zip(usable, sims)}


def found(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.vec_id, r["rank"])):
        out.setdefault(row.vec_id, []).append(row.neighbor)
        assert len(out[row.vec_id]) == row["rank"]
    return out


@pytest.fixture(scope="module")
def clustered():
    """Twelve clusters; a third of the rows are copies of one vector."""
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(12, 8))
    rows = centres[np.arange(600) % 12] + 0.05 * draw.normal(size=(600, 8))
    rows = np.concatenate([rows, np.repeat(rows[:1], 300, axis=0), np.zeros((2, 8))])
    return draw.permutation(rows).astype(np.float32)


@pytest.mark.parametrize("block_rows, max_shells", [(20, 50_000), (4096, 50_000), (20, 4), (25, 1)])
def test_exact(spark, clustered, block_rows, max_shells):
    got = knn_cosine(frame(spark, clustered), 10, block_rows=block_rows, max_shells=max_shells)
    assert found(got) == brute_force(clustered, 10)


@pytest.fixture
def staged(monkeypatch):
    from seqembed.operators import neighbors
    tables = {}
    plain = neighbors.stage

    def keep(df, label):
        tables[label] = plain(df, label)
        return tables[label]

    monkeypatch.setattr(neighbors, "stage", keep)
    return tables


@pytest.mark.parametrize("max_shells", [50_000, 3])
def test_orthogonal_rows_tie(spark, staged, max_shells):
    """All similarities are equal: each search of a block gives k hits per row at most."""
    matrix = np.eye(60, dtype=np.float32)
    assert found(knn_cosine(frame(spark, matrix), 3, block_rows=12, max_shells=max_shells)) == brute_force(matrix, 3)
    assert staged["knn-home"].selectExpr("max(size(found))").first()[0] <= 3
    assert staged["knn-blocks"].groupBy("block").count().selectExpr("max(count)").first()[0] <= 12


def test_ids_that_are_text(spark):
    draw = np.random.default_rng(5)
    matrix = np.round(draw.normal(size=(80, 2)))
    rows = [(f"n{i}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    got = found(knn_cosine(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 4, block_rows=10))
    order = sorted(range(80), key=lambda i: rows[i][0])
    want = brute_force(matrix[order], 4)
    assert got == {rows[order[i]][0]: [rows[order[j]][0] for j in near] for i, near in want.items()}


def test_fewer_rows_than_neighbours(spark):
    matrix = np.array([[1, 0], [1, 1], [1, 1], [0, 2]], np.float32)
    assert found(knn_cosine(frame(spark, matrix), 15)) == brute_force(matrix, 15)


def test_no_usable_rows(spark):
    assert knn_cosine(frame(spark, np.zeros((3, 2), np.float32)), 2).count() == 0
    assert knn_cosine(frame(spark, np.zeros((3, 2), np.float32)).limit(0), 2).count() == 0


def test_far_blocks_are_not_visited(spark, clustered, staged):
    knn_cosine(frame(spark, clustered), 5, block_rows=20)
    blocks = staged["knn-blocks"].select("block").distinct().count()
    visits = staged["knn-home"].selectExpr("avg(size(visits))").first()[0]
    assert blocks > 20 and visits < blocks / 2


def test_projection(spark):
    draw = np.random.default_rng(3)
    matrix = (draw.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 7).astype(np.float32)
    got = np.array([[r.x, r.y] for r in sorted(pca_2d(frame(spark, matrix)).collect(), key=lambda r: r.vec_id)])
    centred = matrix.astype(float) - matrix.astype(float).mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose(got, centred @ axes, atol=1e-6)


def test_missing_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (7, [float("inf"), 0.0])]
    near = knn_cosine(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2)
    assert sorted((r.vec_id, r.neighbor) for r in near.collect()) == [(1, 3), (3, 1)]
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="different lengths|inhomogeneous"):
        knn_cosine(ragged, k=2).collect()


@pytest.mark.parametrize("max_shells", [50_000, 4])
def test_rows_are_sent_once_per_band(spark, monkeypatch, staged, max_shells):
    """Without structure rows reach nearly all blocks; what is sent follows the bands, however small the blocks are."""
    from seqembed.operators import neighbors
    matrix = np.random.default_rng(7).normal(size=(600, 16)).astype(np.float32)
    sent = []
    plain = neighbors._away
    monkeypatch.setattr(neighbors, "_away", lambda visits, blocked, search: sent.append(visits.count()) or plain(visits, blocked, search))
    assert found(knn_cosine(frame(spark, matrix), 5, block_rows=10, max_shells=max_shells)) == brute_force(matrix, 5)
    assert staged["knn-blocks"].select("block").distinct().count() >= 60
    assert sent[0] <= len(matrix) * staged["knn-blocks"].select("band").distinct().count() <= len(matrix) * (neighbors.BANDS + 3)

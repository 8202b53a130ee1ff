"""Links of embeddings against all pairs."""

import numpy as np
import pytest

from seqembed.llm import itq
from seqembed.llm.queries import op1_itq_near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """n_links and component of each row."""
    vectors = [(None if v is None or any(x is None for x in v) else np.array(v, float), l) for _, v, l in rows]
    good = [v is not None and l is not None and np.isfinite(v).all() and (v * v).sum() > 0 for v, l in vectors]
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i][0], vectors[j][0]
            if good[i] and good[j] and vectors[i][1] == vectors[j][1] and len(a) == len(b):
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i].append(j)
                    links[j].append(i)
    label = [r[0] for r in rows]
    for _ in range(n):
        before = list(label)
        for i in range(n):
            for j in links[i]:
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return sorted((r[0], len(links[i]), label[i], r[0] == label[i]) for i, r in enumerate(rows))


def clustered(seed, n, noise, size=64):
    draw = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = draw.normal(size=size)
        for _ in range(draw.integers(1, 6)):
            v = (centre + draw.normal(size=size) * noise).astype(np.float32)
            out.append((len(out), v.tolist(), int(draw.integers(0, 2))))
            if draw.random() < 0.2:
                out.append((len(out), v.tolist(), out[-1][2]))
    return out


def test_close_clusters_are_exact(spark):
    rows = clustered(1, 400, 0.1)
    got = sorted(map(tuple, itq.report(spark.createDataFrame(rows, SCHEMA), cell=60).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("noise", [0.2, 0.26])
def test_recall_near_the_threshold(spark, noise):
    rows = clustered(2, 600, noise)  # cosines of 0.96 and 0.93 on average
    got = sorted(map(tuple, itq.report(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0


def test_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op1_itq_near_dedup(spark, folder).collect())) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 1),
            (12, [1.0, 2.0, 0.0], 1), (13, [1.0, 2.0, 0.0], 1), (14, [-1.0, -2.0], 1), (15, [5.0], 2), (16, [1.0], 2), (17, [1.0, 2.0], 2)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS code")
    assert sorted(map(tuple, itq.report(docs).collect())) == brute(rows)
    assert itq.report(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], SCHEMA)
    assert sorted(map(tuple, itq.report(none).collect())) == [(None, 1, None, False)] * 2

"""The permutation, its inverse and the laws of the shards."""

import zlib
from collections import Counter

import duckdb
import pytest

from seqembed.llm import shards
from seqembed.llm.queries import SQL, op6_feistel_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutes(n):
    for seed in (0, 5):
        p = shards.Permutation(n, seed)
        places = [p.place(i) for i in range(n)]
        assert sorted(places) == list(range(n)) and [p.row(x) for x in places] == list(range(n))
        assert all(shards.row_at(p, *shards.locate(p, i, 7), 7) == i for i in range(n))


def test_columns_and_integers_agree(spark):
    for n in (1, 3, 11, 1000, 12345):
        p = shards.Permutation(n, 3)
        rows = p.apply(spark.range(n).selectExpr("id", "id AS left"), "left").collect()
        assert all(r.left == p.place(r.id) for r in rows) and len(rows) == n


def test_spreads():
    p = shards.Permutation(40_000)
    moved = [p.place(i) for i in range(40_000)]
    assert sum(abs(a - b) for a, b in zip(moved, moved[1:])) / 40_000 > 10_000  # a third on average


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = op6_feistel_shards(spark, folder)
    columns = got.columns
    rows = sorted(map(tuple, got.collect()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r[1] == len(texts[r[0]].encode()) + 16 and r[2] == zlib.crc32(texts[r[0]].encode()) for r in rows)
    laws(rows, len(texts))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        result = duck.execute(SQL["op6_feistel_shards"])
        assert [c[0] for c in result.description] == columns and sorted(result.fetchall()) == rows


def laws(rows, n):
    assert len(rows) == n
    counts = Counter(r[4] for r in rows)
    sizes = [counts[s] for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(40))
    for shard, size in counts.items():
        assert sorted(r[5] for r in rows if r[4] == shard) == list(range(size))


def test_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 70_000), (3, None), *((i, f"t{i}") for i in range(100, 250))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS shard").repartition(3)
    got = [tuple(r) for r in shards.report(docs).collect()]
    laws(got, len(rows))
    assert {r[:3] for r in got if r[0] in (None, 3)} == {(None, 16, 0), (3, 16, 0)}
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in shards.report(docs.repartition(7)).collect())
    assert shards.report(docs.limit(0)).collect() == []
    assert shards.assign(docs, ["doc_id", "text"])[1] == ["_row", "_shard", "slot"]

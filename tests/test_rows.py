import random

import pytest
from pyspark.sql import Window, functions as F

from seqembed.operators import rank, rows
from seqembed.operators.lookup import lookup_join
from seqembed.operators.rank import row_numbers, top_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows, null a third, and values repeat."""
    draw = random.Random(1)
    data = [(draw.choice([None, None, None, "a", "b", "hot", "hot", "hot", "hot", "hot"]), draw.randrange(20), i)
            for i in range(3000)]
    return spark.createDataFrame(data, "key string, value int, id int").cache()


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("limit", [0, rank.WINDOW_ROWS])
@pytest.mark.parametrize("size", [None, "n"])
def test_row_numbers_of_keys(skewed, many_parts, monkeypatch, limit, size):
    monkeypatch.setattr(rank, "WINDOW_ROWS", limit)
    order = [F.desc("value"), "id"]
    got = row_numbers(skewed, order, ["key"], size=size)
    window = Window.partitionBy("key")
    wanted = got.withColumn("want", F.row_number().over(window.orderBy(*order))).withColumn(
        "rows", F.count("*").over(window)).collect()
    assert len(wanted) == 3000
    assert all(r.row_number == r.want for r in wanted)
    assert size is None or all(r.n == r.rows for r in wanted)


def test_hot_key_is_split(skewed, many_parts, monkeypatch):
    monkeypatch.setattr(rank, "WINDOW_ROWS", 0)
    staged = []
    plain = rank.stage
    monkeypatch.setattr(rank, "stage", lambda df, label: staged.append(plain(df, label)) or staged[-1])
    row_numbers(skewed, ["value", "id"], ["key"])
    parts = staged[0].filter("key = 'hot'").select("_part").distinct().count()
    assert parts > 1


def test_row_numbers_of_a_table(skewed, many_parts):
    got = row_numbers(skewed, ["value", F.desc("id")], size="n").collect()
    ordered = sorted(got, key=lambda r: r.row_number)
    assert [r.row_number for r in ordered] == list(range(1, 3001))
    assert ordered == sorted(got, key=lambda r: (r.value, -r.id))
    assert {r.n for r in got} == {3000}


def test_ties_are_split_and_kept(spark, many_parts, monkeypatch):
    copies = spark.range(4000).select(F.lit("same").alias("seq_id"), (F.col("id") % 3).alias("x"))
    staged = []
    plain = rank.stage
    monkeypatch.setattr(rank, "stage", lambda df, label: staged.append(plain(df, label)) or staged[-1])
    split = rows.equal_split(copies, 4, ["seq_id"])
    assert [r["count"] for r in split.groupBy("node").count().collect()] == [1000] * 4
    numbered = next(df for df in staged if "_part" in df.columns)
    assert numbered.select("_part").distinct().count() > 1 and "x" not in numbered.columns  # ties split, only keys sorted
    assert rows.batch_ids(copies, 300, ["seq_id"]).groupBy("batch_id").count().count() == 14


def test_row_numbers_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, id int")
    assert row_numbers(empty, ["id"]).count() == 0
    assert row_numbers(empty, ["id"], ["key"]).count() == 0


@pytest.mark.parametrize("threshold", ["1000", "1"])
def test_top_per_group(spark, skewed, threshold):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        got = top_per_group(skewed, ["key"], [F.desc("value"), F.col("id")], 5, spread=["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    data = skewed.collect()
    for key in (None, "a", "b", "hot"):
        want = sorted((r for r in data if r.key == key), key=lambda r: (-r.value, r.id))[:5]
        mine = sorted((r for r in got if r.key == key), key=lambda r: r.rank)
        assert [(r.id, r.rank) for r in mine] == [(r.id, i + 1) for i, r in enumerate(want)]


@pytest.mark.parametrize("top", [5, 1000])
def test_limit_rows(skewed, monkeypatch, top):
    monkeypatch.setattr(rows, "TOP_ROWS", top)
    assert sorted(r.id for r in rows.limit_rows(skewed, 40, ["id"]).collect()) == list(range(40))
    assert rows.limit_rows(skewed, 0, ["id"]).count() == 3000
    assert rows.limit_rows(skewed, 9999, ["id"]).count() == 3000


def test_splits(skewed):
    sizes = [r["count"] for r in rows.equal_split(skewed, 7, ["id"]).groupBy("node").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    hashed = [r["count"] for r in rows.hash_split(skewed, 4, "id").groupBy("node").count().collect()]
    assert sum(hashed) == 3000 and min(hashed) > 600
    plan = {(r.shard, r.n_rows) for r in rows.shard_plan(skewed, 800).collect()}
    assert plan == {(0, 800), (1, 800), (2, 800), (3, 600)}
    assert rows.shard_plan(skewed.limit(0), 800).count() == 0
    assert [tuple(r) for r in rows.shard_plan(skewed, 3000).collect()] == [(0, 3000)]


def test_drop_values_keeps_nulls(spark, skewed):
    nulls = skewed.filter("key IS NULL").count()
    kept = nulls + skewed.filter("key = 'b'").count()
    assert rows.drop_values(skewed, "key", ["a", "hot"]).count() == kept
    listed = spark.createDataFrame([("a",), ("hot",)], "key string")
    assert rows.drop_values(skewed, "key", listed).count() == kept
    assert rows.drop_values(skewed, "key", []).count() == 3000


def test_lookup_join_beyond_the_bound(spark, skewed):
    names = spark.createDataFrame([("a", 1), ("hot", 2)], "key string, code int")
    small = sorted(map(repr, lookup_join(skewed, names, "key").collect()))
    large = sorted(map(repr, lookup_join(skewed, names, "key", max_rows=1).collect()))
    assert small == large and len(small) == 3000


def test_cap_keys(skewed):
    assert {r.key for r in rows.cap_keys(skewed.filter("key IS NOT NULL"), "key", 2).collect()} == {"a", "b"}


def test_spread_keeps_a_full_scan(spark):
    assert rows.spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9
    assert rows.spread(spark.range(0, 100, 1, 2)).rdd.getNumPartitions() == 4


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    """A split of narrow rows holds many; the partial sums of the cells hold one entry for each."""
    from seqembed.operators.rows import spread
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "narrow"))
    scan = spark.read.parquet(str(tmp_path / "narrow"))
    dealt = spread(scan, 500)
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 20_000
    assert dealt.groupBy(F.spark_partition_id()).count().selectExpr("max(count)").first()[0] <= 600
    assert spread(scan, 10**6).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

import glob

import pytest
from pyspark.sql import functions as F

from seqembed.plans.guards import already_done, check_dim, postflight, preflight, reconcile
from seqembed.plans.reports import eta_minutes, speedup, throughput, util_overall, util_summary
from seqembed.schemas import EMBEDDINGS, RUNS, SEQUENCES
from seqembed.sinks import files
from seqembed.sources.tables import read_stage, read_table, sql_over_path

# Published sweep: batch, compile, block, pretok, wall seconds, rate, speed-up against the first run.
SWEEP = [
    (32, False, "default", False, 152.6, 655.4, 1.00),
    (64, False, "default", False, 163.3, 612.2, 0.93),
    (128, False, "default", False, 163.6, 611.2, 0.93),
    (128, False, "256 MB", False, 161.5, 619.2, 0.94),
    (128, True, "default", False, 227.2, 440.2, 0.67),
    (128, False, "default", True, 125.4, 797.3, 1.22),
    (256, False, "default", True, 126.4, 791.3, 1.21),
]


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([(f"s{i:04d}", "A" * (i % 9 + 1)) for i in range(1200)], SEQUENCES)


def test_published_sweep(spark):
    runs = spark.createDataFrame(
        [(i, b, c, blk, p, 100_000, wall, 8) for i, (b, c, blk, p, wall, _, _) in enumerate(SWEEP)], RUNS)
    for row in speedup(runs, 0).collect():
        wall, rate, factor = SWEEP[row.run_id][4:]
        assert row.rate == pytest.approx(rate, rel=2e-3)
        assert row.rate_per_worker == pytest.approx(rate / 8, rel=2e-3)
        assert row.speedup == pytest.approx(factor, abs=0.006)


def test_no_wall_time(spark):
    runs = spark.createDataFrame([(0, 1, False, "", False, 10, 0.0, 2)], RUNS)
    row = throughput(runs).first()
    assert row.rate == row.rate_per_worker == 0
    assert speedup(runs, 0).first().speedup is None


def test_utilisation(spark):
    rows = [(0, 90, 10), (0, 89, 20), (1, 100, 5), (1, 0, 7)]
    samples = spark.createDataFrame(rows, "device int, util int, mem int")
    assert tuple(util_overall(samples).first()) == (69.75, 50.0)
    assert {tuple(r) for r in util_summary(samples).collect()} == {
        (0, 2, 89.5, 89, 90, 15.0, 20), (1, 2, 50.0, 0, 100, 6.0, 7)}
    assert tuple(util_overall(samples.limit(0)).first()) == (None, None)


def test_eta(spark):
    assert spark.range(1).select(eta_minutes(F.lit(1_000_000), 32, 8)).first()[0] == pytest.approx(13.02, abs=0.01)


def test_guards(spark, sequences, tmp_path):
    with pytest.raises(FileNotFoundError):
        preflight(spark, str(tmp_path / "none"))
    empty, full = str(tmp_path / "empty"), str(tmp_path / "full")
    sequences.limit(0).write.parquet(empty)
    with pytest.raises(ValueError):
        preflight(spark, empty)
    assert files.write_stage(sequences, full) == 1200
    assert preflight(spark, full).count() == 1200
    assert postflight(spark, full, 1200) == 1200
    with pytest.warns(UserWarning):
        postflight(spark, full, 7)
    with pytest.raises(FileNotFoundError):
        postflight(spark, str(tmp_path / "none"), 0)
    assert tuple(reconcile(sequences, sequences.limit(3)).first()) == (1200, 3, False)


def test_skip_when_done(spark, sequences, tmp_path):
    assert not already_done(spark, "not_there")
    for n, done in ((100, False), (101, True)):
        sequences.orderBy("seq_id").limit(n).write.mode("overwrite").option(
            "path", str(tmp_path / f"t{n}")).saveAsTable(f"guard_{n}")
        assert already_done(spark, f"guard_{n}") is done


def test_shards_and_parts(spark, sequences, tmp_path):
    shards, parts = str(tmp_path / "shards"), str(tmp_path / "parts")
    files.write_shards(sequences.coalesce(1), shards)
    assert sorted(r.n_rows for r in files.describe_output(spark, shards).collect()) == [200, 500, 500]
    exact = str(tmp_path / "exact")
    files.write_shards(sequences.repartition(3), exact, rows=250, order=["seq_id"])
    assert sorted(r.n_rows for r in files.describe_output(spark, exact).collect()) == [200, 250, 250, 250, 250]
    numbered = str(tmp_path / "numbered")
    files.write_shards(sequences.repartition(7), numbered, rows=250, exact=True)
    assert sorted(r.n_rows for r in files.describe_output(spark, numbered).collect()) == [200, 250, 250, 250, 250]
    assert sorted(map(tuple, spark.read.parquet(numbered).collect())) == sorted(map(tuple, sequences.collect()))
    files.write_partitioned(sequences.withColumn("node", F.length("sequence") % 3), parts)
    assert len(glob.glob(f"{parts}/node=*")) == 3
    assert read_stage(spark, parts).count() == 1200


def test_modes_and_promotion(spark, sequences, tmp_path):
    path = str(tmp_path / "stage")
    files.write_stage(sequences, path)
    with pytest.raises(Exception):
        files.write_stage(sequences, path)
    assert files.write_stage(sequences.limit(10), path, mode="overwrite") == 10
    for rows in (10, 4):
        files.write_stage(sequences.limit(rows), path, mode="overwrite")
        files.promote(spark, path, "promoted", location=str(tmp_path / "table"))
        assert read_table(spark, "promoted", "seq_id").count() == rows
    assert sql_over_path(spark, path).columns == ["seq_id", "sequence"]


def test_publish_keeps_the_old_table_when_a_write_breaks(spark, sequences, tmp_path):
    place = str(tmp_path / "published")
    assert files.publish(sequences, "published", location=place) == 1200
    broken = sequences.withColumn("sequence", F.when(F.col("seq_id") == "s0700", F.raise_error(F.lit("lost"))).otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="lost"):
        files.publish(broken, "published", location=place)
    assert spark.table("published").count() == 1200
    # A table may be replaced by what is read from it, and other columns take its name.
    assert files.publish(spark.table("published").filter("seq_id < 's0010'"), "published", location=place) == 10
    assert sorted(r.seq_id for r in spark.table("published").collect()) == [f"s{i:04d}" for i in range(10)]
    assert files.publish(sequences.select(F.length("sequence").alias("n")), "published", location=place) == 1200
    assert spark.table("published").columns == ["n"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("published_")]
    spark.sql("DROP TABLE published")
    assert files.publish(sequences.limit(3), "published") == 3 and spark.table("published").count() == 3
    spark.sql("DROP TABLE published")


def test_csv_and_dims(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [3.0, 4.0])], EMBEDDINGS)
    path = str(tmp_path / "csv")
    files.export_csv(df.coalesce(1), path, 2)
    text = open(glob.glob(f"{path}/*.csv")[0]).read().split()
    assert text[0] == "0,1" and sorted(text[1:]) == ["1.0,2.5", "3.0,4.0"]
    assert tuple(check_dim(df, 2).first()) == (2, 2, True)
    assert tuple(check_dim(df, 1280).first()) == (2, 2, False)

import json

import pytest
from pyspark.sql import functions as F

from seqembed.__main__ import main
from seqembed.functions.models import StandIn
from seqembed.plans import jobs
from seqembed.plans.cells import CellSettings
from seqembed.plans.embed import embed
from seqembed.sources.synth import synth_sequences
from seqembed.sources.tables import read_first


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "staged rows")
    synth_sequences(spark, 230).repartitionByRange(5, "seq_id").sortWithinPartitions("seq_id").write.parquet(path)
    return path


def ids(df):
    return sorted(r.seq_id for r in df.select("seq_id").collect())


@pytest.mark.parametrize("n, rows", [(0, 230), (1, 1), (46, 46), (100, 100), (230, 230), (999, 230)])
def test_read_first(spark, staged, n, rows):
    assert ids(read_first(spark, staged, n)) == [f"synth_{i:06d}" for i in range(rows)]


def files_opened(df):
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().totalNumberOfFiles()


def test_read_first_opens_only_what_it_needs(spark, staged):
    assert files_opened(read_first(spark, staged, 60)) == 2


def test_read_first_of_many_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for i in range(2000):
        pq.write_table(pa.table({"x": [2 * i, 2 * i + 1]}), tmp_path / f"part-{i:05d}.parquet")
    rows = read_first(spark, str(tmp_path), 3001)
    assert files_opened(rows) == 1501
    assert rows.agg(F.count("x"), F.max("x"), F.count_distinct("x")).first() == (3001, 3000, 3001)


def test_embed_jobs_agree(spark, staged, tmp_path):
    want = {r.seq_id: r.embedding for r in embed(spark.read.parquet(staged)).collect()}
    tokens = str(tmp_path / "tokens")
    jobs.pretokenize_job(spark, staged, tokens, max_length=1024, shard_rows=100)
    raw = jobs.embed_job(spark, staged, str(tmp_path / "raw"))
    pre = jobs.embed_job(spark, tokens, str(tmp_path / "pre"), pretokenized=True, batch_size=128)
    split = jobs.embed_job(spark, staged, str(tmp_path / "split"), nodes=3)
    for name, report in (("raw", raw), ("pre", pre), ("split", split)):
        got = spark.read.parquet(str(tmp_path / name))
        assert {r.seq_id: r.embedding for r in got.collect()} == want
        assert report.input_rows == report.output_rows == 230 and report.rate > 0


def test_limited_run_matches_its_count(spark, staged, tmp_path, recwarn):
    report = jobs.embed_job(spark, staged, str(tmp_path / "out"), limit=50)
    assert report.input_rows == report.output_rows == 50
    assert not [w for w in recwarn if "expected" in str(w.message)]
    with pytest.raises(Exception):
        jobs.embed_job(spark, staged, str(tmp_path / "out"))


def test_table_job(spark, staged, tmp_path):
    spark.read.parquet(staged).write.mode("overwrite").option("path", str(tmp_path / "src")).saveAsTable("job_src")
    where = str(tmp_path / "dst")
    assert jobs.embed_table_job(spark, "job_src", "job_dst", 64, limit=120, location=where)
    assert ids(spark.table("job_dst")) == [f"synth_{i:06d}" for i in range(120)]
    with pytest.raises(ValueError):
        jobs.embed_table_job(spark, "job_src", "job_dst", 1280, location=where)
    assert spark.table("job_dst").count() == 120
    assert jobs.embed_table_job(spark, "job_src", "job_dst", 64, location=where)  # the rest
    assert ids(spark.table("job_dst")) == [f"synth_{i:06d}" for i in range(230)]
    assert not jobs.embed_table_job(spark, "job_src", "job_dst", 64, location=where)
    assert jobs.embed_table_job(spark, "job_src", "job_dst", 8, model=StandIn(8))  # other embeddings replace these
    assert spark.table("job_dst").filter("size(embedding) = 8").count() == spark.table("job_dst").count() == 230
    with pytest.raises(ValueError):
        jobs.embed_table_job(spark, "job_src", "job_other", 1280, location=str(tmp_path / "other"))


def test_stage_sources(spark, tmp_path):
    rows = [(f"id{i}" if i % 3 else None, "" if i % 2 else "AC" * i, "GH" * i) for i in range(40)]
    spark.createDataFrame(rows, "id string, text string, sequence string").coalesce(1).write.parquet(
        str(tmp_path / "corpus"))
    stats = jobs.stage_job(spark, "corpus", str(tmp_path / "a"), str(tmp_path / "corpus"), n=20, max_len=9)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    want = {(f"id{i}" if i % 3 else f"uniref50_{i:06d}", (("GH" if i % 2 else "AC") * i)[:9]) for i in range(1, 20)}
    assert got == want and stats.first().n_rows == 19

    spark.createDataFrame([(f"A{i}",) for i in range(5)], "text string").write.parquet(str(tmp_path / "bare"))
    assert jobs.stage_job(spark, "corpus", str(tmp_path / "b"), str(tmp_path / "bare")).first().n_rows == 5

    stats = jobs.stage_job(spark, "synthetic", str(tmp_path / "c"), n=70, max_len=300).first()
    assert stats.n_rows == 70 and stats.max_len <= 300
    with pytest.raises(ValueError):
        jobs.stage_job(spark, "other", str(tmp_path / "d"))


def test_cell_job(spark, tmp_path):
    counts = spark.range(600).select(
        (F.col("id") % 7).cast("string").alias("cell_id"), (F.col("id") % 11).cast("string").alias("gene_id"),
        (F.col("id") % 5).cast("double").alias("count"))
    vocab = spark.range(11).select(F.col("id").cast("string").alias("gene_id"), (F.col("id") + 3).cast("int").alias("token_id"))
    out = str(tmp_path / "cells")
    written = jobs.cell_job(spark, counts, vocab, out, settings=CellSettings(max_seq_len=8), model=StandIn(4), dims=4)
    assert written.count() == 7
    assert spark.read.csv(f"{out}.csv", header=True).columns == ["0", "1", "2", "3"]


def test_no_cell_vanishes(spark, tmp_path):
    rows = [("a", "g1", 5.0), ("a", "g2", 1.0), ("b", "g1", 0.0), ("c", "other", 3.0), ("d", "g2", 2.0), ("d", "g1", 1.0)]
    counts = spark.createDataFrame(rows, "cell_id string, gene_id string, count double")
    vocab = spark.createDataFrame([("g1", 3), ("g2", 4)], "gene_id string, token_id int")
    out = [str(tmp_path / f"cells{i}") for i in range(3)]
    run = lambda i, **s: sorted(r.cell_id for r in jobs.cell_job(
        spark, counts, vocab, out[i], settings=CellSettings(max_seq_len=4, **s), model=StandIn(4)).collect())
    assert run(0) == ["a", "b", "c", "d"]
    assert run(1, min_gene_counts=2, max_cells=1) == ["a"]  # the cap comes after the filter
    with pytest.raises(ValueError):
        run(2, max_mitochondrial_prop=0.1)


def test_profiles_reach_the_workers(spark, staged, tmp_path, monkeypatch):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
    from pyspark.sql.classic.dataframe import DataFrame
    profile = ResourceProfileBuilder().require(TaskResourceRequests().resource("gpu", 1)).build
    plain, seen = DataFrame.mapInArrow, []

    def watched(self, func, schema, barrier=False, profile=None):
        seen.append(profile)
        return plain(self, func, schema, barrier)  # local mode grants no profile

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    jobs.embed_job(spark, staged, str(tmp_path / "out"), limit=5, profile=profile)
    spark.read.parquet(staged).write.option("path", str(tmp_path / "src")).mode("overwrite").saveAsTable("profile_src")
    jobs.embed_table_job(spark, "profile_src", "profile_dst", 64, limit=5, location=str(tmp_path / "dst"), profile=profile)
    counts = spark.createDataFrame([("a", "g", 1.0)], "cell_id string, gene_id string, count double")
    vocab = spark.createDataFrame([("g", 3)], "gene_id string, token_id int")
    jobs.cell_job(spark, counts, vocab, str(tmp_path / "cells"), settings=CellSettings(max_seq_len=4), profile=profile)
    assert seen.count(profile) == 3


def test_jobs_leave_no_scratch(spark, staged, tmp_path):
    from pathlib import Path
    from seqembed.session import scratch_root
    scratch = Path(scratch_root(spark)) / "seqembed"
    before = set(scratch.iterdir()) if scratch.exists() else set()
    (tmp_path / "x.fasta").write_text(">a|B|c\nMK\n>no\nAC\n")
    assert jobs.stage_job(spark, "fasta", str(tmp_path / "f"), str(tmp_path / "x.fasta"), shard_rows=1, exact_shards=True).first().n_rows == 2
    spark.read.parquet(staged).write.option("path", str(tmp_path / "src")).mode("overwrite").saveAsTable("scratch_src")
    assert jobs.embed_table_job(spark, "scratch_src", "scratch_dst", 64, limit=20, location=str(tmp_path / "dst"))
    counts = spark.createDataFrame([("a", "g", 1.0)], "cell_id string, gene_id string, count double")
    vocab = spark.createDataFrame([("g", 3)], "gene_id string, token_id int")
    settings = CellSettings(max_seq_len=4, gene_values="bin", bins=2, compute_medians=True)
    assert jobs.cell_job(spark, counts, vocab, str(tmp_path / "cells"), settings=settings).count() == 1
    assert set(scratch.iterdir()) == before


def test_staging_takes_all_and_whole(spark, tmp_path):
    spark.createDataFrame([("A" * 3000,)] * 1500, "text string").write.parquet(str(tmp_path / "in"))
    stats = jobs.stage_job(spark, "corpus", str(tmp_path / "out"), str(tmp_path / "in"), max_len=None).first()
    assert (stats.n_rows, stats.min_len) == (1500, 3000)
    (tmp_path / "x.fasta").write_text(">a|B|c\n" + "MK" * 900 + "\n")
    stats = jobs.stage_job(spark, "fasta", str(tmp_path / "f"), str(tmp_path / "x.fasta"), max_len=None).first()
    assert (stats.n_rows, stats.max_len) == (1, 1800)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.fasta").write_text(">db|P1|n\nMKV\n>db|P2|n\nAC\n")
    staged, tokens, out = (str(tmp_path / name) for name in ("staged", "tokens", "out"))
    main(["stage", "--source", "fasta", "--input", str(tmp_path / "x.fasta"), "--output", staged])
    assert json.loads(capsys.readouterr().out) == {"n_rows": 2, "min_len": 2, "median_len": 3, "max_len": 3}
    main(["pretokenize", "--input", staged, "--output", tokens, "--max-length", "16"])
    main(["embed", "--input", tokens, "--output", out, "--pretokenized", "--model", "stand-in"])
    assert json.loads(capsys.readouterr().out)["output_rows"] == 2
    spark.read.parquet(staged).write.option("path", str(tmp_path / "src")).mode("overwrite").saveAsTable("cli_src")
    main(["table", "--source", "cli_src", "--target", "cli_dst", "--dims", "64", "--location", str(tmp_path / "dst"), "--model", "stand-in"])
    assert json.loads(capsys.readouterr().out) == {"embedded": True, "rows": 2}
    counts, vocab, lists, cells = (str(tmp_path / name) for name in ("counts", "vocab", "lists", "cells"))
    spark.createDataFrame([("a", "g", 2.0), ("a", "h", 1.0), ("b", "h", 1.0)], "cell_id string, gene_id string, count double").write.parquet(counts)
    spark.createDataFrame([("g", 3), ("h", 4)], "gene_id string, token_id int").write.parquet(vocab)
    (tmp_path / "medians.json").write_text('{"g": 4.0}')
    main(["cells", "--counts", counts, "--vocab", vocab, "--medians", str(tmp_path / "medians.json"), "--tokens", lists, "--output", cells,
          "--max-seq-len", "4", "--gene-values", "rank", "--cls-id", "1", "--model", "stand-in"])
    assert json.loads(capsys.readouterr().out) == {"cells": 2}
    assert {r.cell_id: (r.gene_ids, r.gene_values) for r in spark.read.parquet(lists).collect()} == {
        "a": ([1, 4, 3], [0.0, 1.0, 0.5]), "b": ([1, 4], [0.0, 1.0])}
    main(["smoke", "--output", str(tmp_path / "smoke")])
    assert "n_rows" in capsys.readouterr().out

import gzip

import pytest
from pyspark.sql import functions as F

from seqembed.operators.lengths import length_stats
from seqembed.operators.positions import file_positions
from seqembed.sources.corpus import read_corpus
from seqembed.sources.fasta import read_fasta
from seqembed.sources.synth import RESIDUES, SHARES, synth_sequences
from seqembed.sources.tables import file_stem, read_lookup, smoke_input, with_metadata


def fasta(spark, tmp_path, text, **options):
    (tmp_path / "a.fasta").write_bytes(text.encode())
    return {tuple(r) for r in read_fasta(spark, str(tmp_path), **options).collect()}


@pytest.mark.parametrize("text, expected", [
    (">sp|P1|A x\nMKV\nLL\n>sp|P2|B\nAC\n", {("P1", "MKVLL"), ("P2", "AC")}),
    (">sp|P1|A\nMKV\n>sp|P2|B\nAC", {("P1", "MKV"), ("P2", "AC")}),
    (">sp|P1|A\r\nMKV  \r\nLL\t\r\n>sp|P2|B\r\nAC\r\n", {("P1", "MKVLL"), ("P2", "AC")}),
    (">sp|P1|A\n>sp|P2|B\nAC\n>sp|P3|C\n", {("P2", "AC")}),
    ("junk\nmore\n>sp|P1|A\nMKV\n", {("P1", "MKV")}),
    (">plain\nAA\n>sp|P1|A\nMKV\n>other\nCC\n", {("sp_000000", "AA"), ("P1", "MKV"), ("sp_000002", "CC")}),
    (">empty\n>sp|P1|A\nMKV\n>other\nCC\n", {("P1", "MKV"), ("sp_000001", "CC")}),
    (">>sp|P1|A\nMKV\n>>q|P2|B\nAA\n", {("P1", "MKV"), ("P2", "AA")}),
    (">a\nAA\n>b\n>c\nCC\n>d\n>e\nEE\n", {("sp_000000", "AA"), ("sp_000001", "CC"), ("sp_000002", "EE")}),
    ("junk\n>b\n>c\nCC\n>d\nDD\n", {("sp_000000", "CC"), ("sp_000001", "DD")}),
    (">sp|P1|A\n M KV\n\nLL\n", {("P1", " M KVLL")}),
    ("", set()),
    ("no header at all\n", set()),
])
def test_fasta_cases(spark, tmp_path, text, expected):
    assert fasta(spark, tmp_path, text) == expected


def test_fasta_cut_and_first_records(spark, tmp_path):
    text = "".join(f">sp|P{i}|x\n{'A' * i}\n" for i in range(1, 9))
    assert fasta(spark, tmp_path, text, max_len=3, n=4) == {
        ("P1", "A"), ("P2", "AA"), ("P3", "AAA"), ("P4", "AAA")}


def test_fasta_in_many_blocks_and_gzip(spark, tmp_path):
    records = [(f"P{i}", "ACDEFGHIKL" * (1 + i % 7)) for i in range(500)]
    text = "".join(f">db|{name}|n\n{body[:25]}\r\n{body[25:]} \n" for name, body in records)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.fasta").write_text(text)
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "a.fasta.gz").write_bytes(gzip.compress(text.encode()))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for folder in ("plain", "zipped"):
            got = read_fasta(spark, str(tmp_path / folder)).collect()
            assert sorted(tuple(r) for r in got) == sorted(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_fallback_ids_run_through_files_and_blocks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.fasta").write_text("".join(f">x\n{name}{i:03d}\n" for i in range(300)))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.seq_id: r.sequence for r in read_fasta(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == {f"sp_{i:06d}": f"{'ab'[i // 300]}{i % 300:03d}" for i in range(600)}


def test_corpus_counts_raw_rows(spark):
    rows = [(0, "a", "TEXT", "SEQ"), (1, "b", "", "SEQ"), (2, "c", None, ""), (3, None, "LONGTEXT", None),
            (4, "e", "E", None)]
    df = spark.createDataFrame(rows, "pos int, id string, text string, sequence string")
    for options in ({"order": ["pos"]}, {"position": "pos"}):
        got = read_corpus(df, n=4, max_len=4, **options).collect()
        assert {tuple(r) for r in got} == {("a", "TEXT"), ("b", "SEQ"), ("uniref50_000003", "LONG")}


def test_positions_in_files(spark, tmp_path):
    for name, ids in (("b", range(100, 130)), ("a", range(100)), ("c", range(130, 131))):
        spark.range(ids.start, ids.stop, 1, 1).write.parquet(str(tmp_path / "in" / f"part={name}"))
    rows = file_positions(spark.read.parquet(str(tmp_path / "in")))
    assert all(r.id == r._position for r in rows.collect()) and rows.count() == 131
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_long_numbers_are_not_cut(spark):
    from seqembed.sources.corpus import numbered_id
    assert spark.range(1).select(numbered_id(F.lit(12345678), "sp_")).first()[0] == "sp_12345678"


def test_synthetic_sequences(spark):
    df = synth_sequences(spark, 400)
    rows = {tuple(r) for r in df.collect()}
    again = {tuple(r) for r in synth_sequences(spark, 400).repartition(3).collect()}
    assert rows == again and len(rows) == 400
    lengths = [len(s) for _, s in rows]
    assert min(lengths) >= 50 and max(lengths) <= 1024 and abs(sum(lengths) / 400 - 200) < 15
    letters = "".join(s for _, s in rows)
    for residue, share in zip(RESIDUES, SHARES):
        assert abs(letters.count(residue) / len(letters) - share / 1002) < 0.005
    other = {tuple(r) for r in synth_sequences(spark, 400, seed=7).collect()}
    assert not {s for _, s in rows} & {s for _, s in other}


@pytest.mark.parametrize("lengths, expected", [
    ([5], (1, 5, 5, 5)), ([1, 2, 3], (3, 1, 2, 3)), ([1, 2, 3, 4], (4, 1, 3, 4)), ([2, 2, 2, 9], (4, 2, 2, 9)),
    ([], (0, None, None, None)),
])
def test_length_stats(spark, lengths, expected):
    df = spark.createDataFrame([("A" * n,) for n in lengths], "sequence string")
    assert tuple(length_stats(df).first()) == expected


def test_lookup_and_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "g1": 1.5,\n "g2": 2\n}')
    assert {tuple(r) for r in read_lookup(spark, str(tmp_path / "m.json")).collect()} == {("g1", 1.5), ("g2", 2.0)}
    rows = spark.createDataFrame([("x.h5.parquet",), ("y.parquet",)], "file_name string")
    meta = spark.createDataFrame([("y.parquet", "named")], "file_name string, dataset string")
    assert {tuple(r) for r in with_metadata(rows, meta).collect()} == {
        ("x.h5.parquet", "x.h5"), ("y.parquet", "named")}
    assert spark.range(1).select(file_stem(F.lit("/a/b.c/cells.h5ad"))).first()[0] == "cells"


def test_smoke_input(spark):
    assert [tuple(r) for r in smoke_input(spark).orderBy("id").collect()] == [(i, float(i)) for i in range(64)]

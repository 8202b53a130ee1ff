import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from seqembed.functions.alphabet import PROTEIN
from seqembed.functions.batches import Doubler, map_batches
from seqembed.functions.models import StandIn
from seqembed.functions.pooling import masked_mean, plain_mean, pool_column
from seqembed.functions.tokenize import mask_from_ids, pad_right, token_ids, tokenize
from seqembed.plans.embed import embed, embed_cells, embed_whole
from seqembed.schemas import SEQUENCES, SMOKE_OUT
from seqembed.sources.synth import synth_sequences
from seqembed.sources.tables import smoke_input

CASES = ["", "L", "LAGV", "LAGVSE", "LAGVSER", "LAGVSERTID", "JJx-.", "lag", "Lé語A"]


def vectors(df):
    return {r[0]: tuple(r[1]) for r in df.collect()}


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(s, s) for s in CASES], SEQUENCES)


def expected_ids(text, max_length):
    ids = [PROTEIN.tokens.index(c) if c in PROTEIN.tokens else 3 for c in text[:max_length - 2]]
    return [0, *ids, 2]


@pytest.mark.parametrize("max_length", [8, 12])
def test_fixed_width(cases, max_length):
    for row in tokenize(cases, max_length).collect():
        ids = expected_ids(row.seq_id, max_length)
        rest = max_length - len(ids)
        assert row.input_ids == ids + [1] * rest
        assert row.attention_mask == [1] * len(ids) + [0] * rest


def test_column_form_agrees(cases):
    ids = token_ids(F.col("sequence"), 8)
    padded = cases.select("seq_id", pad_right(ids, 8, 1).alias("ids"))
    want = {r.seq_id: (r.input_ids, r.attention_mask) for r in tokenize(cases, 8).collect()}
    masked = padded.select("seq_id", "ids", mask_from_ids(F.col("ids"), 1).alias("mask"))
    assert {r.seq_id: (r.ids, r.mask) for r in masked.collect()} == want


def test_longest_in_batch(cases):
    rows = tokenize(cases, 8, padding="longest", batch_size=2).collect()
    ordered = sorted(rows, key=lambda r: r.seq_id)
    for i in range(0, len(ordered), 2):
        pair = ordered[i:i + 2]
        width = max(len(expected_ids(r.seq_id, 8)) for r in pair)
        assert {len(r.input_ids) for r in pair} == {width} == {len(r.attention_mask) for r in pair}
        assert {r.batch_id for r in pair} == {i // 2}


def test_repeated_ids_stay_apart(spark):
    df = spark.createDataFrame([("a", "LA"), ("a", "LAGV"), ("a", "LA"), ("b", "L")], SEQUENCES)
    longest = tokenize(df, 8, padding="longest", batch_size=4).collect()
    assert sorted(sum(r.attention_mask) for r in longest) == [3, 4, 4, 6]
    assert embed(df).count() == 4


def test_batching_and_partitions_do_not_matter(spark):
    df = synth_sequences(spark, 120)
    want = vectors(embed(df, batch_size=32))
    assert len(want) == 120
    for batch_size, partitions in ((1, 1), (7, 5), (500, 3)):
        assert vectors(embed(df.repartition(partitions), batch_size=batch_size)) == want


def test_pretokenized_agrees(spark, cases):
    df = synth_sequences(spark, 60).union(cases)
    want = vectors(embed(df, max_length=128))
    assert vectors(embed(tokenize(df, 128), max_length=128, pretokenized=True)) == want
    longest = tokenize(df, 128, padding="longest").select("seq_id", "input_ids", "attention_mask")
    assert vectors(embed(longest, max_length=128, pretokenized=True)) == want


def test_rows_without_tokens(spark):
    rows = [("none", [], []), ("masked", [5, 6], [0, 0]), ("gap", [5, 6, 7], [1, 0, 1])]
    df = spark.createDataFrame(rows, "seq_id string, input_ids array<int>, attention_mask array<int>")
    got = vectors(embed(df, StandIn(2), pretokenized=True))
    hidden = lambda x, i: np.array([(31 * x + 17 * d + 7 * i) % 1009 for d in range(2)])
    assert got["none"] == got["masked"] == (0.0, 0.0)
    assert got["gap"] == tuple((hidden(5, 0) + hidden(7, 2)) / 2)


@pytest.mark.parametrize("split", [0, 1, 3])
def test_whole_sequences(spark, split):
    texts = ["", "L", "LAGVSE", "LAGVSER", "LAGVSERTIDPKQNFYMHWC" * 7, "Lé語A" * 5, None, "LAGVSE", "X" * 5000]
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)] + [("s1", "LL")], SEQUENCES)

    def plain(text):
        hidden = []
        for at in range(0, max(1, len(text)), 6):
            ids = expected_ids(text[at:at + 6], 8)
            hidden += [[(31 * x + 17 * d + 7 * i) % 1009 for d in range(5)] for i, x in enumerate(ids)]
        return tuple(np.float32(sum(h[d] for h in hidden) / len(hidden)) for d in range(5))

    got = embed_whole(df, StandIn(5), max_length=8, batch_size=3, split_windows=split).collect()
    want = sorted([(f"s{i}", plain(t or "")) for i, t in enumerate(texts)] + [("s1", plain("LL"))])
    assert sorted((r.seq_id, tuple(r.embedding)) for r in got) == want
    assert embed_whole(df.limit(0), StandIn(5), split_windows=split).count() == 0
    short = df.filter("length(sequence) <= 6 AND seq_id <> 's1'")
    assert vectors(embed_whole(short, StandIn(5), max_length=8, split_windows=split)) == vectors(embed(short, StandIn(5), 8))


def test_null_sequence_is_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], SEQUENCES)
    got = vectors(embed(df))
    assert got["a"] == got["b"]


def test_constant_model(spark):
    def factory():
        return lambda ids, mask: np.full((*ids.shape, 3), 2.5, np.float32)

    assert set(vectors(embed(synth_sequences(spark, 9), factory)).values()) == {(2.5, 2.5, 2.5)}


def test_pools():
    hidden = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    ones = np.ones((2, 3), np.int32)
    assert (masked_mean(hidden, ones) == plain_mean(hidden, ones)).all()
    assert (masked_mean(hidden, 0 * ones) == 0).all()
    one = np.array([[0, 1, 0], [1, 0, 0]])
    assert (masked_mean(hidden, one) == hidden[[0, 1], [1, 0]]).all()


def test_pool_column(spark):
    hidden = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    mask = lambda *bits: F.array(*[F.lit(b) for b in bits])
    row = spark.range(1).select(
        pool_column(hidden), pool_column(hidden, mask(1, 0)), pool_column(hidden, mask(0, 0))).first()
    assert [list(v) for v in row] == [[2.0, 4.0], [1.0, 2.0], [0.0, 0.0]]


def test_cells_pool_the_padding(spark):
    df = spark.createDataFrame([("c", [5, 9])], "cell_id string, gene_ids array<int>")
    value = vectors(embed_cells(df, StandIn(1), seq_len=4))["c"][0]
    assert value == sum((31 * x + 7 * i) % 1009 for i, x in enumerate([5, 9, 0, 0])) / 4


def test_smoke_job(spark):
    for workers in (None, 3):
        out = map_batches(smoke_input(spark), Doubler("dev"), SMOKE_OUT, batch_size=8, workers=workers)
        assert sorted(tuple(r) for r in out.collect()) == [(i, 2.0 * i, "dev") for i in range(64)]


def test_batches_do_not_span_partitions(spark):
    def factory():
        return lambda columns: {"n": np.full(len(columns["id"]), len(columns["id"]))}

    schema = T.StructType([T.StructField("n", T.LongType())])
    sizes = map_batches(spark.range(0, 100, 1, 4), factory, schema, batch_size=10).collect()
    assert sorted(r.n for r in sizes) == [5] * 20 + [10] * 80

"""What a worker holds does not follow the rows of an Arrow batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from seqembed.functions import tokenize
from seqembed.functions.alphabet import PROTEIN
from seqembed.functions.models import StandIn
from seqembed.plans import embed

ROWS, WIDTH = 10_000, 1024


def texts(longest):
    draw = np.random.default_rng(3)
    return pa.array(["LAGVX" * (n // 5) for n in draw.integers(0, longest, ROWS)])


def peak(worker, batch):
    """Most MB held while rows are worked off and dropped, and their number."""
    tracemalloc.start()
    rows = sum(out.num_rows for out in worker(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, rows


@pytest.mark.parametrize("longest", [WIDTH - 2, 12])
def test_tokens(longest):
    ids = pa.array(np.arange(ROWS))
    fixed = pa.record_batch([ids, texts(longest)], names=["seq_id", "sequence"])
    most, rows = peak(tokenize._FixedWidth(WIDTH, PROTEIN), fixed)
    assert rows == ROWS and most < 60
    wide = pa.record_batch([ids, ids, texts(longest), pa.array(np.full(ROWS, WIDTH, np.int32))],
                           names=["seq_id", "batch_id", "sequence", "width"])
    most, rows = peak(tokenize._Widths(PROTEIN), wide)
    assert rows == ROWS and most < 60


def test_embedding_of_tokens():
    lists = [pa.ListArray.from_arrays(np.arange(ROWS + 1, dtype=np.int32) * WIDTH, pa.array(np.ones(ROWS * WIDTH, np.int32))) for _ in range(2)]
    batch = pa.record_batch([pa.array(np.arange(ROWS)), *lists], names=["seq_id", "input_ids", "attention_mask"])
    worker = embed._Embedder("seq_id", embed._read_tokens, StandIn(4), "masked", 32, 1, 0)
    most, rows = peak(worker, batch)
    assert rows == ROWS and most < 100


def test_runs_keep_rows_and_widths(monkeypatch):
    rows = ["LAG", "", None, "V" * 7, "SERT"]
    widths = [5, 9, 2, 9, 9]
    batch = pa.record_batch([pa.array(range(5)), pa.array([0, 1, 2, 1, 1]), pa.array(rows), pa.array(widths, pa.int32())],
                            names=["seq_id", "batch_id", "sequence", "width"])
    whole = pa.Table.from_batches(tokenize._Widths(PROTEIN)(iter([batch])))
    fixed = pa.Table.from_batches(tokenize._FixedWidth(9, PROTEIN)(iter([batch])))
    monkeypatch.setattr(tokenize, "RUN_CELLS", 10)
    assert pa.Table.from_batches(tokenize._Widths(PROTEIN)(iter([batch]))).to_pylist() == whole.to_pylist()
    assert pa.Table.from_batches(tokenize._FixedWidth(9, PROTEIN)(iter([batch]))).to_pylist() == fixed.to_pylist()
    assert [len(r["input_ids"]) for r in whole.to_pylist()] == widths

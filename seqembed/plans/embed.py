"""Embed sequences and cells: tokens into a plug-in model, pooled inside the worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.alphabet import PROTEIN, Alphabet
from ..functions.arrays import byte_runs, framed_codes, list_codes, list_column, pad_rows, windowed_codes
from ..functions.models import StandIn, resident
from ..functions.pooling import POOLS
from ..session import ship_package, stage

RUN_BYTES = 4 << 20
RUN_WINDOWS = 4096


def embed(df: DataFrame, model: Callable = StandIn(), max_length: int = 1024, batch_size: int = 32,
          pretokenized: bool = False, alphabet: Alphabet = PROTEIN, workers: int | None = None,
          profile: ResourceProfile | None = None) -> DataFrame:
    """`(seq_id, sequence)`, or tokens when `pretokenized`, to `(seq_id, embedding)`.

    Raw sequences cross to Python as text and become ids there, a byte lookup on the Arrow buffer,
    which moves about a tenth of the bytes of the token arrays. Only what `max_length` can use is
    sent. The mean is taken over unmasked positions, special tokens included.

    Nothing is shuffled unless `workers` asks for that many partitions, which suits a small input and
    a slow model.
    """
    if pretokenized:
        inputs = df.select("seq_id", "input_ids", "attention_mask")
        reader = _read_tokens
    else:
        body = F.substring("sequence", 1, max_length - 2)
        inputs = df.select("seq_id", body.alias("sequence"))
        reader = _SequenceReader(alphabet)
    return _run(inputs, "seq_id", reader, model, "masked", batch_size, alphabet.pad_id, 0,
                workers, profile)


def embed_cells(df: DataFrame, model: Callable = StandIn(), seq_len: int = 2048,
                batch_size: int = 4, pad_id: int = 0, workers: int | None = None,
                profile: ResourceProfile | None = None) -> DataFrame:
    """`(cell_id, gene_ids)` to `(cell_id, embedding)`.

    Token lists are padded to `seq_len` and the mean is taken over all `seq_len` positions.
    """
    inputs = df.select("cell_id", "gene_ids")
    reader = _GeneReader(seq_len)
    return _run(inputs, "cell_id", reader, model, "all", batch_size, pad_id, seq_len, workers,
                profile)


def embed_whole(df: DataFrame, model: Callable = StandIn(), max_length: int = 1024, batch_size: int = 32,
                alphabet: Alphabet = PROTEIN, split_windows: int = 0, workers: int | None = None,
                profile: ResourceProfile | None = None) -> DataFrame:
    """`(seq_id, sequence)` to `(seq_id, embedding)`, nothing cut off.

    A sequence is cut into windows of `max_length` tokens, cls and eos included; each is a model input of its own.
    The embedding is the mean over the unmasked positions of all windows: sums of states and their counts merge.
    A sequence of one window has the embedding that `embed` gives it.

    Without `split_windows` a row stays in its task and nothing is shuffled. With it rows are cut into parts of so
    many windows, which are dealt over all tasks (`workers` of them, if given); each part sends one sum, and sums
    are merged again by row. That is for sequences that are long enough to hold up a task.
    """
    ship_package(df.sparkSession)
    body = max_length - 2
    embedding = T.StructField("embedding", T.ArrayType(T.FloatType()))
    inputs = df.select("seq_id", "sequence")
    id_field = T.StructField("seq_id", inputs.schema["seq_id"].dataType)
    if not split_windows:
        inputs = inputs.repartition(workers) if workers else inputs
        worker = _WindowSums(model, batch_size, alphabet, body, merge=True)
        return inputs.mapInArrow(worker, T.StructType([id_field, embedding]), profile=profile)
    # Staged, so that a row keeps its number whatever is computed again.
    rows = stage(inputs.withColumn("row", F.monotonically_increasing_id()), "whole")
    parts = rows.select("row", "sequence").mapInArrow(_Parts(body * split_windows), "row long, part long, sequence string")
    parts = parts.repartition(workers, "row", "part") if workers else parts.repartition("row", "part")
    sums = parts.select("row", "sequence").mapInArrow(
        _WindowSums(model, batch_size, alphabet, body, merge=False), "row long, sums array<double>, n long", profile=profile)
    merged = sums.repartition("row").sortWithinPartitions("row").mapInArrow(
        _MergeSums(), T.StructType([T.StructField("row", T.LongType()), embedding]))
    return rows.select("row", "seq_id").join(merged, "row").select("seq_id", "embedding")


class _Parts:
    """(row, sequence) to (row, part, sequence) with at most `size` characters each."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_runs(batches, RUN_BYTES):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [(text or "")[at:at + self.size] for at in range(0, max(1, len(text or "")), self.size)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()),
                    pa.array(parts, pa.string())], names=["row", "part", "sequence"])


class _WindowSums:
    """(key, sequence) to sums of states over all windows and their number, or, merged, to (key, mean)."""

    def __init__(self, model, batch_size: int, alphabet: Alphabet, body: int, merge: bool):
        self.model, self.batch_size, self.alphabet, self.body, self.merge = model, batch_size, alphabet, body, merge

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, pad = resident(self.model), self.alphabet.pad_id
        for batch in byte_runs(batches, RUN_BYTES):
            ids, starts, lengths, row = windowed_codes(batch.column(1), self.alphabet, self.body)
            total, counts = None, np.bincount(row, lengths, minlength=batch.num_rows)
            for first in range(0, len(row), RUN_WINDOWS):
                order = first + np.argsort(lengths[first:first + RUN_WINDOWS], kind="stable")
                for at in range(0, len(order), self.batch_size):
                    rows = order[at:at + self.batch_size]
                    tokens = pad_rows(ids, starts[rows], lengths[rows], int(lengths[rows].max()), pad)
                    seen = (np.arange(tokens.shape[1]) < lengths[rows, None]).astype(np.int32)
                    states = forward(tokens, seen)
                    sums = np.matmul(seen.astype(np.float32)[:, None, :], states)[:, 0, :].astype(np.float64)
                    total = np.zeros((batch.num_rows, sums.shape[1])) if total is None else total
                    np.add.at(total, row[rows], sums)
            if self.merge:
                means = (total / counts[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(means)], names=["seq_id", "embedding"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), list_column(total), pa.array(counts.astype(np.int64))],
                                                 names=["row", "sums", "n"])


class _MergeSums:
    """Sorted (row, sums, n) to (row, mean): the sums of a row are added; the last row of a batch waits for the next."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, bounds = list_codes(batch.column(1))
            row, sums, n = batch.column(0).to_numpy(), values.reshape(len(bounds) - 1, -1), batch.column(2).to_numpy()
            if held is not None:
                row, sums, n = np.append(held[0], row), np.concatenate([held[1], sums]), np.append(held[2], n)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            row, sums, n = row[first], np.add.reduceat(sums, first), np.add.reduceat(n, first)
            held = row[-1:], sums[-1:], n[-1:]
            if len(row) > 1:
                yield self._means(row[:-1], sums[:-1], n[:-1])
        if held is not None:
            yield self._means(*held)

    @staticmethod
    def _means(row: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), list_column((sums / n[:, None]).astype(np.float32))],
                                          names=["row", "embedding"])


def _run(inputs, id_column, reader, model, pool, batch_size, pad_id, width, workers, profile):
    if workers:
        inputs = inputs.repartition(workers)
    ship_package(inputs.sparkSession)
    schema = T.StructType([
        T.StructField(id_column, inputs.schema[id_column].dataType),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ])
    worker = _Embedder(id_column, reader, model, pool, batch_size, pad_id, width)
    return inputs.mapInArrow(worker, schema, profile=profile)


class _SequenceReader:
    """Rows of ids from a text column: cls, residues, eos."""

    def __init__(self, alphabet: Alphabet):
        self.alphabet = alphabet

    def __call__(self, batch: pa.RecordBatch):
        return *framed_codes(batch.column("sequence"), self.alphabet), None


def _read_tokens(batch: pa.RecordBatch):
    """Rows of ids and mask from token columns, padding at the end of a row left off."""
    ids, bounds = list_codes(batch.column("input_ids"))
    mask, _ = list_codes(batch.column("attention_mask"))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    offsets = np.arange(len(ids)) - bounds[rows] + 1
    lengths = np.zeros(len(bounds) - 1, np.int64)
    np.maximum.at(lengths, rows[mask != 0], offsets[mask != 0])
    return ids, bounds[:-1], lengths, mask


class _GeneReader:
    def __init__(self, seq_len: int):
        self.seq_len = seq_len

    def __call__(self, batch: pa.RecordBatch):
        ids, bounds = list_codes(batch.column("gene_ids"))
        return ids, bounds[:-1], np.minimum(np.diff(bounds), self.seq_len), None


class _Embedder:
    """Arrow batches in, ids and pooled vectors out; hidden states live for one model call only.

    Rows of a run of `RUN_BYTES` are taken in order of length, so that a model call pads little.
    """

    def __init__(self, id_column, reader, model, pool, batch_size, pad_id, width):
        self.id_column = id_column
        self.reader = reader
        self.model = model
        self.pool = pool
        self.batch_size = batch_size
        self.pad_id = pad_id
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, pool = resident(self.model), POOLS[self.pool]
        for batch in byte_runs(batches, RUN_BYTES):
            values, starts, lengths, mask = self.reader(batch)
            order = np.argsort(lengths, kind="stable")
            pooled = []
            for at in range(0, len(order), self.batch_size):
                rows = order[at:at + self.batch_size]
                width = self.width or max(int(lengths[rows].max()), 1)
                ids = pad_rows(values, starts[rows], lengths[rows], width, self.pad_id)
                if mask is None:
                    seen = (ids != self.pad_id).astype(np.int32)
                else:
                    seen = pad_rows(mask, starts[rows], lengths[rows], width, 0)
                pooled.append(pool(forward(ids, seen), seen))
            vectors = list_column(np.concatenate(pooled))
            names = batch.column(self.id_column).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([names, vectors], names=[self.id_column, "embedding"])

"""Byte-level BPE on numpy matrices: encode texts to token ids and decode ids to bytes.

A text is cut by the split pattern; each piece is merged on its own. Pieces that a worker has not
met yet are put into zero-padded matrices, one per length class, and all rows of a matrix advance
together: every row merges its leftmost pair of lowest rank in each round, the row is closed up,
and rows without a pair left are taken out of the matrix. The rank of a pair comes from one open
addressing hash table over the keys (left id, right id).

Missing and empty texts give no ids. Repeated rows are encoded each on its own. A text that is a
single long piece works too: rows longer than `LONG` are merged with a heap instead of a matrix,
as a matrix round costs the length of the row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fresh, pieces, sha256_hex, ship_package

NONE = np.int32(2**31 - 1)  # the rank of a pair that never merges
LONG = 512
CACHED_PIECES = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


class Vocabulary:
    """The ranks of a vocabulary file with its pair table; a few MB, built once on the driver."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        size = max(ranks.values()) + 1
        token = [b""] * size
        for data, rank in ranks.items():
            token[rank] = data
        self.lengths = np.fromiter(map(len, token), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.single = np.fromiter((ranks[bytes([b])] for b in range(256)), np.int32, 256)
        pairs = {}
        for data, rank in ranks.items():
            for cut in range(1, len(data)):
                left, right = ranks.get(data[:cut]), ranks.get(data[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._hash(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE)
        todo, at = np.arange(len(keys)), (keys * _MIX >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[at] == _EMPTY
            slots, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[todo[winners]], values[todo[winners]]
            rest = np.ones(len(todo), bool)
            rest[winners] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it has none. An id below 0 is padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo].astype(np.uint64) << np.uint64(32) | right.ravel()[todo].astype(np.uint64)
        at = (keys * _MIX >> self.shift).astype(np.int64)
        flat = out.reshape(-1)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            flat[todo[hit]] = self.values[at[hit]]
            rest = ~hit & (found != _EMPTY)
            todo, keys, at = todo[rest], keys[rest], (at[rest] + 1) & self.mask
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `words`, one after the other, and how many ids each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids: list = [None] * len(words)
        order = np.argsort(sizes, kind="stable")
        begin = int(np.searchsorted(sizes[order], 1))
        for where in order[:begin]:
            ids[where] = np.empty(0, np.int32)
        while begin < len(order):
            width = int(sizes[order[begin]])
            if width > LONG:
                for where in order[begin:]:
                    ids[where] = self._merge_long(words[where])
                break
            width = min(LONG, max(8, width + width // 4))
            end = int(np.searchsorted(sizes[order], width, "right"))
            for first in range(begin, end, 1 << 14):
                rows = order[first:min(end, first + (1 << 14))]
                self._merge_rows([words[r] for r in rows], sizes[rows], rows, ids)
            begin = end
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), counts

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, rows: np.ndarray, ids: list) -> None:
        width = int(sizes.max())
        matrix = np.full((len(words), width), -1, np.int32)
        matrix[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        sizes = sizes.copy()
        ranks = np.full((len(words), width), NONE, np.int32)  # a last column for the pair that is none
        ranks[:, :-1] = self.rank(matrix[:, :-1], matrix[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            every = np.arange(len(at))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    ids[rows[i]] = matrix[i, :sizes[i]].copy()
                keep = ~done
                if not keep.any():
                    return
                rows, sizes, at, best = rows[keep], sizes[keep], at[keep], best[keep]
                width = int(sizes.max())
                matrix, ranks = matrix[keep, :width], ranks[keep, :width]
                every = np.arange(len(at))
            columns = np.arange(width)
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            matrix, ranks = np.take_along_axis(matrix, source, 1), np.take_along_axis(ranks, source, 1)
            matrix[every, at] = best
            sizes -= 1
            matrix[every, sizes] = -1
            ranks[every, sizes] = NONE
            after = np.where(at + 1 < width, matrix[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.rank(best, after)
            before = np.maximum(at - 1, 0)
            changed = self.rank(np.where(at > 0, matrix[every, before], -1), best)
            ranks[every, before] = np.where(at > 0, changed, ranks[every, before])

    def _merge_long(self, word: bytes) -> np.ndarray:
        token = self.single[np.frombuffer(word, np.uint8)].tolist()
        size = len(token)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        first = self.rank(np.array(token[:-1], np.int32), np.array(token[1:], np.int32)).tolist()
        heap = [(rank, i, token[i], token[i + 1]) for i, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= size or token[j] != right:
                continue  # one side has been merged since
            token[i], token[j] = rank, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size:
                    value = self._one(token[a], token[b])
                    if value != NONE:
                        heapq.heappush(heap, (value, a, token[a], token[b]))
        return np.array([t for t in token if t >= 0], np.int32)

    def _one(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = (key * int(_MIX) & (2**64 - 1)) >> int(self.shift)
        while (found := int(self.keys[at])) != int(_EMPTY):
            if found == key:
                return int(self.values[at])
            at = at + 1 & self.mask
        return int(NONE)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Encode:
    """Puts the ids, as the last column, in place of the text in Arrow batches."""

    def __init__(self, vocabulary, text: int):
        self.vocabulary, self.text = vocabulary, text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.vocabulary.value
        split = regex.compile(words.pattern).findall
        known: dict[str, int] = {}
        flat, starts, counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in pieces(batches):
            parts = [split(text or "") for text in batch.column(self.text).to_pylist()]
            if len(known) > CACHED_PIECES:
                known, flat, starts, counts = {}, flat[:0], starts[:0], counts[:0]
            new = list(set().union(*parts).difference(known))
            ids, sizes = words.merge([piece.encode() for piece in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            starts = np.concatenate([starts, len(flat) + np.cumsum(sizes) - sizes])
            counts, flat = np.concatenate([counts, sizes]), np.concatenate([flat, ids])
            index = np.fromiter((i for part in parts for i in map(known.__getitem__, part)), np.int64,
                                sum(map(len, parts)))
            lengths = counts[index]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, parts)])]
            values = pa.array(flat[spans(starts[index], lengths)], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            columns = [*batch.columns[:self.text], *batch.columns[self.text + 1:], lists]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


class _Decode:
    """Arrow batches of (..., ids) with the decoded bytes as one more column."""

    def __init__(self, vocabulary, column: int):
        self.vocabulary, self.column = vocabulary, column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = self.vocabulary.value
        for batch in pieces(batches):
            lists = batch.column(self.column).fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            if len(ids) and (ids.min() < 0 or ids.max() >= len(words.lengths)):
                raise ValueError("an id is not in the vocabulary")
            lengths = words.lengths[ids]
            data = words.bytes[spans(words.starts[ids], lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
            decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[str(i) for i in range(batch.num_columns + 1)])


def shared(spark: SparkSession, path: str, pattern: str):
    """The vocabulary at `path` as a broadcast variable; its size is that of the file, not of the data."""
    ship_package(spark)
    return spark.sparkContext.broadcast(Vocabulary.load(path, pattern))


def encode(docs: DataFrame, vocabulary, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with the ids in place of the text, and the name of that last column; `vocabulary` comes from `shared`."""
    (name,) = fresh(docs, "ids")
    at = docs.columns.index(text_col)
    rest = [field for i, field in enumerate(docs.schema.fields) if i != at]
    schema = T.StructType([*rest, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_Encode(vocabulary, at), schema), name


def decode(encoded: DataFrame, vocabulary, ids_col: str = "ids") -> tuple[DataFrame, str]:
    """`encoded` with the bytes of the ids in a last column, whose name is returned.

    Missing ids count as none; ids that are not in the vocabulary raise.
    """
    (name,) = fresh(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])
    return encoded.mapInArrow(_Decode(vocabulary, encoded.columns.index(ids_col)), schema), name


def report(docs: DataFrame, vocabulary) -> DataFrame:
    """Counts and digests of every row of `docs`, encoded and decoded."""
    encoded, ids = encode(docs.select("doc_id", "text"), vocabulary)
    decoded, data = decode(encoded, vocabulary, ids)
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col(ids).cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_hex(data).alias("decoded_sha256"))

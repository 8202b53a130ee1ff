"""Substring dedup: windows of words that start more than once, found with a count-min prefilter.

A window is `size` consecutive words of one document. Every word covered by a window whose words also start
anywhere else is removed; windows are judged on the input.

1. Sketch. Of each window one shorter run of words stands for it, its minimiser: the run of `size` // 2 + 1 words
   with the least hash. Equal windows have equal minimisers at equal places, so a repeated window has a minimiser
   that starts at two places at least. About a tenth of all places are minimisers. Each partition counts them in a
   count-min sketch; the sketches are merged block by block, and what is broadcast is one bit a cell: two or more.
2. Prefilter. A window whose minimiser has a clear bit in either row of the sketch starts once. Estimates are
   never too low, so no repeated window is lost. Documents without a candidate are finished here.
3. Exact pass. The windows left are grouped by 96 bits of hash over all of their words, and those that start
   twice go back to their documents, packed for 64 documents at a time.

The sketch grows with the text up to `MAX_CELLS` cells, 32 MB of bits. Beyond that it is loaded more, lets more
windows through, and the exact pass has more to shuffle; results stay the same.

A window that fills a third of the corpus is no hot group: what a task meets twice, it marks on the spot, and
sends one row for others to see. A task sends each such key once. Sketches are merged in levels of `FAN` partitions.

Missing and empty texts have no words. Repeated rows are copies of each other. Words are compared by 64 bits of hash.
Texts are worked off whole: a worker holds some 75 bytes per byte of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pieces, ship_package, stage

MAX_CELLS = 1 << 27
MIN_CELLS = 1 << 16
BLOCK = 1 << 16
ROWS = 2
FAN = 256
KNOWN_KEYS = 200_000
PART_ROWS = 1_000_000
PACK_BITS = 6

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ x >> np.uint64(32)


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.full(size, b, np.uint64) for b in (self.base, self.inverse))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


_powers = [_Powers(base) for base in _BASES]


def _runs(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each `size` consecutive values; the last `size` - 1 places have none."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers[base].take(len(values) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])
    return _mix((sums[size:] - sums[:-size]) * down[:n])


class Words:
    """The words of a run of texts, as hashes: one flat array, and where each text begins. `fold` takes A-Z for a-z."""

    def __init__(self, column: pa.Array, fold: bool = False):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        # A space before each text and after the last keeps words of different texts apart.
        padded = np.full(len(data) + len(column) + 1, 32, np.uint8)
        places = np.arange(len(data)) + np.repeat(np.arange(1, len(column) + 1), np.diff(offsets))
        padded[places] = data
        self.edges = offsets + np.arange(len(column) + 1)  # those spaces
        space = _SPACE[padded]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        up, down = _powers[0].take(len(padded) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_FOLDED if fold else _LETTERS)[padded] * up[:-1])])
        self.hashes = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.data, self.starts, self.ends = padded, starts, ends
        self.first = np.searchsorted(starts, self.edges)  # first word of each text

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places at which a window begins, the place of its minimiser, and the hash of the latter."""
        short = size // 2 + 1
        grams = _runs(self.hashes, short, 1)
        n = len(self.hashes) - size + 1
        if n <= 0:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        inside = np.zeros(n, bool)
        lengths = np.diff(self.first)
        long = np.flatnonzero(lengths >= size)
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, self.first[long], 1)
        np.add.at(steps, self.first[long] + lengths[long] - size + 1, -1)
        inside = np.cumsum(steps[:-1]) > 0
        reach = size - short + 1
        least, at = grams[:n].copy(), np.zeros(n, np.int8)
        for shift in range(1, reach):
            other = grams[shift:shift + n]
            less = other < least
            least[less] = other[less]
            at[less] = shift
        begin = np.flatnonzero(inside)
        return begin, begin + at[begin], least[begin]

    def keys(self, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows that begin at the given places."""
        return _runs(self.hashes, size, 2)[begin], (_runs(self.hashes, size, 3)[begin] >> np.uint64(33)).astype(np.int32)


def _cells(grams: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (_mix(grams + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64)


class _Sketch:
    """Arrow batches of (text) to blocks of the partition's sketch: (block, part, cells, counts), counts of 1 or 2."""

    def __init__(self, size: int, cells: int):
        self.size, self.cells = size, cells

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * self.cells, np.uint8)
        for batch in pieces(batches, 2 << 20):
            _, at, grams = Words(batch.column(0)).windows(self.size)
            _, first = np.unique(at, return_index=True)
            for row in range(ROWS):
                cell, n = np.unique(_cells(grams[first], row, self.cells), return_counts=True)
                cell += row * self.cells
                counts[cell] = np.minimum(2, counts[cell] + np.minimum(n, 2)).astype(np.uint8)
        used = np.flatnonzero(counts)
        block = used // BLOCK
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(used) else [0]
        part = TaskContext.get().partitionId()
        for first in range(0, len(edges) - 1, 256):
            rows = [(int(block[a]), part, (used[a:b] % BLOCK).astype(np.uint16).tobytes(), counts[used[a:b]].tobytes())
                    for a, b in zip(edges[first:first + 256], edges[first + 1:first + 257])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["block", "part", "cells", "counts"])


def _added(table: pa.Table) -> np.ndarray:
    """Counts of the cells of a block, up to 2, over the partitions of the table."""
    counts = np.zeros(BLOCK, np.uint8)
    for cells, n in zip(table.column("cells"), table.column("counts")):
        cell = np.frombuffer(cells.as_py(), np.uint16)
        counts[cell] = np.minimum(2, counts[cell] + np.frombuffer(n.as_py(), np.uint8))
    return counts


def _partly(table: pa.Table) -> pa.Table:
    """The sketch of a block over some partitions."""
    counts = _added(table)
    cells = np.flatnonzero(counts)
    return pa.table([table.column("block").slice(0, 1), table.column("part").slice(0, 1),
                     pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[cells].tobytes()], pa.binary())],
                    names=["block", "part", "cells", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    """The bits of a block: cells that all partitions together count twice or more."""
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(_added(table) >= 2).tobytes()], pa.binary())})


def merged(sketches: DataFrame, partitions: int, fan: int = FAN) -> DataFrame:
    """Bits `(block, bits)` of the partitions' sketches; a task merges `fan` of a block at most at a time."""
    while partitions > fan:
        sketches = sketches.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("block", "part").applyInArrow(
            _partly, "block int, part int, cells binary, counts binary")
        partitions = -(-partitions // fan)
    return sketches.groupBy("block").applyInArrow(_merge, "block int, bits binary")


def sketch(source: DataFrame, size: int, cells: int):
    """Broadcast bits of the merged sketch, `ROWS` x `cells`; `source` has the text alone."""
    sketches = source.mapInArrow(_Sketch(size, cells), "block int, part int, cells binary, counts binary")
    bits = np.zeros((ROWS * cells // BLOCK, BLOCK // 8), np.uint8)
    for row in merged(sketches, source.rdd.getNumPartitions()).toLocalIterator():  # at most ROWS * cells / BLOCK rows
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return source.sparkSession.sparkContext.broadcast(bits.reshape(ROWS, -1))


class _Prefilter:
    """(row, doc_id, text) to (row, doc_id, n_words, sha256, text): text only where a window is a candidate."""

    def __init__(self, bits, size: int, cells: int):
        self.bits, self.size, self.cells = bits, size, cells

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            words = Words(batch.column(2))
            begin = candidates(words, self.bits.value, self.size, self.cells)
            has = np.zeros(batch.num_rows, bool)
            has[np.searchsorted(words.first, begin, "right") - 1] = True
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            digests = [None if h else hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for h, t in zip(has, texts)]
            kept = pa.array([t if h else None for h, t in zip(has, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first)), pa.array(digests, pa.string()), kept],
                names=["row", "doc_id", "n_words", "digest", "text"])


def candidates(words: Words, bits: np.ndarray, size: int, cells: int) -> np.ndarray:
    """Places of the windows that the sketch does not rule out."""
    begin, _, grams = words.windows(size)
    for row in range(ROWS):
        cell = _cells(grams, row, cells)
        keep = (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        begin, grams = begin[keep], grams[keep]
    return begin


class _Windows:
    """(row, text) to (key, check, row, at, state): windows to be grouped.

    State 0: to be judged. 1: known to be repeated, the key is only for the spread. 2: tells others that the key is repeated.
    """

    def __init__(self, bits, size: int, cells: int):
        self.bits, self.size, self.cells = bits, size, cells

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)
        for batch in pieces(batches, 2 << 20):
            words = Words(batch.column(1))
            begin = candidates(words, self.bits.value, self.size, self.cells)
            if not len(begin):
                continue
            key, check = words.keys(begin, self.size)
            text = np.searchsorted(words.first, begin, "right") - 1
            row, at = batch.column(0).to_numpy()[text], (begin - words.first[text]).astype(np.int32)
            # What is met twice here is repeated; 96 bits decide.
            order = np.lexsort((check, key))
            same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
            twice = np.zeros(len(key), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            leader = np.zeros(len(key), bool)
            leader[order] = np.concatenate([[True], ~same])
            told = np.isin(key ^ check.astype(np.uint64), known)
            state = np.where(twice, 1, 0).astype(np.int8)
            teller = twice & leader & ~told
            known = np.unique(np.concatenate([known, (key ^ check.astype(np.uint64))[teller]]))[-KNOWN_KEYS:]
            spread = np.where(twice, _mix(row.astype(np.uint64) + (at // 512).astype(np.uint64)), key)
            columns = [np.concatenate([a, b[teller]]) for a, b in (
                (spread, key), (np.where(twice, 0, check).astype(np.int32), check), (row, row), (at, at))]
            state = np.concatenate([state, np.full(teller.sum(), 2, np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:]), pa.array(state)],
                                             names=["key", "check", "row", "at", "state"])


class _Judge:
    """All windows of some keys to (pack, places): repeated ones, as numbers made of row within the pack and place.

    The windows of a document lie in all partitions, so what a partition returns is packed by many documents.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        key, check, row, at, state = (np.concatenate(column) for column in zip(*held))
        del held
        order = np.lexsort((check, key))
        key, check, row, at, state = (x[order] for x in (key, check, row, at, state))
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
        judged = state != 1
        weight = np.bincount(group[judged], np.where(state[judged] == 2, 2, 1), len(key))
        hit = (state == 1) | ((state == 0) & (weight[group] >= 2))
        row, at = row[hit], at[hit]
        order = np.lexsort((at, row))
        row, at = row[order], at[order].astype(np.int64)
        pack, places = row >> PACK_BITS, (row & (1 << PACK_BITS) - 1) << 32 | at
        for first, end in _stretches(pack, 1024):
            yield pa.RecordBatch.from_arrays([pa.array([int(pack[a]) for a in first], pa.int64()),
                                              pa.array([places[a:b].tobytes() for a, b in zip(first, end)], pa.binary())],
                                             names=["pack", "places"])


def _stretches(keys: np.ndarray, at_once: int) -> Iterator[tuple[list[int], list[int]]]:
    """Where runs of equal keys begin and end, some runs at a time."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist() if len(keys) else []
    for i in range(0, len(edges) - 1, at_once):
        yield edges[i:i + at_once][:len(edges) - 1 - i], edges[i + 1:i + 1 + at_once]


class _Unpack:
    """(pack, parts) to (row, places): the places of each document, as packed 32-bit numbers."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                places = np.sort(np.frombuffer(b"".join(parts.as_py()), np.int64))
                row, at = places >> 32, (places & 0xFFFFFFFF).astype(np.int32)
                for first, end in _stretches(row, 1024):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(row[a]) + (pack << PACK_BITS) for a in first], pa.int64()),
                         pa.array([at[a:b].tobytes() for a, b in zip(first, end)], pa.binary())], names=["row", "places"])


class _Remove:
    """(doc_id, n_words, digest, text, places, ...) with the outcome: removed words and what is left."""

    def __init__(self, size: int, whole: bool):
        self.size, self.whole = size, whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, out = [], []
            for text, places in zip(batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist()):
                words = (text or b"").split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.frombuffer(places or b"", np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + self.size, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                out.append(b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()) if removed[-1] else b" ".join(words))
            n_removed = pa.array(removed, pa.int64())
            if self.whole:
                last = pa.array([None if t is None else x.decode() for t, x in zip(batch.column(3), out)], pa.string())
            else:
                last = pa.array([d or hashlib.sha256(x).hexdigest() for d, x in zip(batch.column(2).to_pylist(), out)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_removed, last],
                                             names=["doc_id", "n_words", "n_removed", "kept"])


def repeated(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What the passes find: documents `(row, doc_id, n_words, digest, text)` and `(row, places)`.

    A document without a candidate has the digest of its words and no text. `places` are packed 32-bit
    numbers of the words at which repeated windows begin.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size_of = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A word takes six bytes or so and two in twenty places are minimisers; four cells for each.
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (size_of // 15).bit_length()))
    bits = sketch(source.select("text"), size, cells)
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = numbered.mapInArrow(_Prefilter(bits, size, cells), T.StructType([
        T.StructField("row", T.LongType()), source.schema["doc_id"], T.StructField("n_words", T.LongType()),
        T.StructField("digest", T.StringType()), T.StructField("text", T.StringType())]))
    found = stage(found, "candidates")
    left = found.filter("text IS NOT NULL")
    n_words = left.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PART_ROWS))
    windows = left.select("row", "text").mapInArrow(
        _Windows(bits, size, cells), "key long, check int, row long, at int, state byte")
    places = (windows.repartition(parts, "key").mapInArrow(_Judge(), "pack long, places binary")
              .groupBy("pack").agg(F.collect_list("places").alias("parts"))
              .mapInArrow(_Unpack(), "row long, places binary"))
    return found, places


def _outcome(docs: DataFrame, size: int, whole: bool) -> DataFrame:
    found, places = repeated(docs, size)
    done = found.filter("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept"))
    judged = found.filter("text IS NOT NULL").join(places, "row", "left").select("doc_id", "n_words", "digest", "text", "places")
    schema = T.StructType([found.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return done.unionByName(judged.mapInArrow(_Remove(size, whole), schema))


def report(docs: DataFrame, size: int = 35) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_sha256)` for every row of `docs`."""
    return _outcome(docs, size, False).withColumnRenamed("kept", "kept_sha256")

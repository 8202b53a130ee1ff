"""Alignment of two tokenizers: groups of tokens between common ends, and counts of linked id pairs.

A is a byte-level BPE vocabulary applied to a space and the text, B a piece model applied to the text, which adds
the space itself. Where a token of A and one of B end at the same byte, both sequences are cut into groups; every
A token of a group is linked with every B token of it.

The ends of A and B are merged by merge paths: in the grid of A ends against B ends, a binary search on every
`WORK`-th diagonal finds where the path of the merge crosses it, which cuts the merge into pieces of equal work
that need nothing of each other. All pieces advance in step. Each emits for its tokens how many common ends it has
passed; groups that reach over a boundary of pieces are stitched by adding the common ends of the pieces before.
Documents of a block are laid end to end, so long and short ones make the same work; no group reaches over the end
of a document, which is a common end.

Links of a group are counted from its distinct ids, so a group of many equal tokens is no product of its tokens.
A worker handles blocks of some `BLOCK_BYTES`, or one longer document, and writes per document its distinct id
pairs with their links, and per block its distinct pairs with the documents that hold them. Blocks' pairs are
summed over the corpus, given back to the blocks they came from, and meet the documents there: a pair crosses the
network once per block, not once per document, and no table of all pairs is ever in one place.

Texts that are missing, empty, or whose joined token bytes differ from space and text have no tokens: zeros and an
empty digest. Rows are documents of their own, whatever their ids, and copies count each. Ties for the highest
count all count. An empty table gives no rows. Only id and text are read, so other columns may have any name. A
worker holds about 60 bytes per byte of the longest document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .bpe import Vocabulary, spans
from .common import pieces, ship_package, stage
from .sentencepieces import ChunkTable, PieceModel, piece_table

WORK = 256
BLOCK_BYTES = 4 << 20
RUN_LINKS = 1 << 20
FAR = np.int64(2**62)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class MergeVocabulary(Vocabulary):
    """A byte-level vocabulary whose merges are those of its file, and no others."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, ids = byte_letters(), model["vocab"]
        plain = {token: bytes(letters[c] for c in token) for token in ids if all(c in letters for c in token)}
        token = [b""] * (max(ids.values()) + 1)
        for name, data in plain.items():
            token[ids[name]] = data
        self.pattern = pattern
        self.lengths = np.fromiter(map(len, token), np.int64, len(token))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.single = np.fromiter((ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])), np.int32, 256)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        values = np.array([ids[a + b] for a, b in merges], np.int64)
        if (np.diff(values) <= 0).any():
            raise ValueError("ids of merged tokens have to be in the order of the merges")
        self._hash(np.array([ids[a] << 32 | ids[b] for a, b in merges], np.uint64), values.astype(np.int32))


class Tokenizers:
    """Both tokenizers; some MB, built once on the driver."""

    def __init__(self, a_path: str, a_pattern: str, b_path: str):
        self.a, self.b = MergeVocabulary(a_path, a_pattern), PieceModel(b_path)
        if len(self.a.lengths) * len(self.b.lengths) > 1 << 31:
            raise ValueError("pairs of ids do not fit in 31 bits")

    a_table: ChunkTable | None = None

    def tables(self) -> tuple[ChunkTable, ChunkTable]:
        """Tables of chunks, kept from task to task of a worker process."""
        if self.a_table is None:
            self.a_table = ChunkTable(regex.compile(self.a.pattern), lambda chunks: self.a.merge([c.encode() for c in chunks]))
        return self.a_table, piece_table(self.b)


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of `a` are among the first at[k] elements of the merge of `a` and `b`, equal ones of `a` first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        earlier = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.maximum(at - 1 - middle, 0)])
        low, high = np.where(earlier, middle + 1, low), np.where(open_ & ~earlier, middle, high)
    return low


def common_groups(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """For each end in the rising `a` and `b`: how many ends common to both lie before it."""
    total = len(a) + len(b)
    in_a, in_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    if not len(a) or not len(b):
        return in_a, in_b
    starts = np.arange(0, total, work)
    first_a = diagonals(a, b, starts)
    first_b = starts - first_a
    i, j, seen = first_a.copy(), first_b.copy(), np.zeros(len(starts), np.int64)
    a_far, b_far = np.append(a, FAR), np.append(b, FAR)
    last = total - int(starts[-1])
    for step in range(min(work, total)):
        if step == last:  # only the last piece may be shorter
            i, j, seen_last = i[:-1], j[:-1], seen[-1:]
            seen = seen[:-1]
        take = a_far[i] <= b_far[j]
        in_a[i[take]] = seen[take]
        from_b = ~take
        at = j[from_b]
        in_b[at] = seen[from_b]
        before = i[from_b] - 1
        seen[from_b] += (before >= 0) & (a[before] == b[at])
        i, j = i + take, j + from_b
    if last < work and last < total:
        seen = np.concatenate([seen, seen_last])
    offsets = np.cumsum(seen) - seen
    in_a += np.repeat(offsets, np.diff(np.append(first_a, len(a))))
    in_b += np.repeat(offsets, np.diff(np.append(first_b, len(b))))
    return in_a, in_b


def _same(ids: np.ndarray, vocabulary, data: bytes) -> bool:
    """Whether the bytes of the ids, joined, are `data`."""
    lengths = vocabulary.lengths[ids]
    if int(lengths.sum()) != len(data):
        return False
    expected, at = np.frombuffer(data, np.uint8), 0
    for first in range(0, len(ids), 1 << 18):
        run = ids[first:first + (1 << 18)]
        found = vocabulary.bytes[spans(vocabulary.starts[run], vocabulary.lengths[run])]
        if not np.array_equal(found, expected[at:at + len(found)]):
            return False
        at += len(found)
    return True


class Aligned:
    """Tokens and groups of the texts of one block; groups are numbered through the block."""

    def __init__(self, tokenizers: Tokenizers, tables, texts: list[str]):
        a_ids, a_sizes = tables[0]([" " + text if text else "" for text in texts])
        b_ids, b_sizes = tables[1]([tokenizers.b.marked(text) for text in texts])
        a_cut, b_cut = np.cumsum(a_sizes), np.cumsum(b_sizes)
        good = np.zeros(len(texts), bool)
        for n, text in enumerate(texts):
            data = (" " + text).encode() if text else b""
            good[n] = (bool(text) and _same(a_ids[a_cut[n] - a_sizes[n]:a_cut[n]], tokenizers.a, data)
                       and _same(b_ids[b_cut[n] - b_sizes[n]:b_cut[n]], tokenizers.b, data))
        self.a_ids, self.b_ids = a_ids[np.repeat(good, a_sizes)], b_ids[np.repeat(good, b_sizes)]
        self.a_sizes, self.b_sizes = np.where(good, a_sizes, 0), np.where(good, b_sizes, 0)
        self.a_groups, self.b_groups = common_groups(
            np.cumsum(tokenizers.a.lengths[self.a_ids]), np.cumsum(tokenizers.b.lengths[self.b_ids]))
        self.documents = len(texts)
        self.a_ends, self.b_ends = np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)
        held = self.a_sizes > 0
        self.n_groups = np.zeros(len(texts), np.int64)
        self.n_groups[held] = (self.a_groups[self.a_ends[held] - 1]
                               - self.a_groups[self.a_ends[held] - self.a_sizes[held]] + 1)

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Ranges of groups of bounded work; a single group may be more."""
        groups = int(self.n_groups.sum())
        a, b = np.bincount(self.a_groups, minlength=groups), np.bincount(self.b_groups, minlength=groups)
        done = np.cumsum(a * b + a + b)
        first = 0
        while first < groups:
            limit = (done[first - 1] if first else 0) + RUN_LINKS
            stop = max(first + 1, int(np.searchsorted(done, limit, "right")))
            yield first, stop
            first = stop

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links of every distinct pair of every document, in this order."""
        found = []
        group_ends = np.cumsum(self.n_groups)
        for first, stop in self._runs():
            a = slice(*np.searchsorted(self.a_groups, [first, stop]))
            b = slice(*np.searchsorted(self.b_groups, [first, stop]))
            left, left_n = np.unique((self.a_groups[a] - first) << 20 | self.a_ids[a], return_counts=True)
            right, right_n = np.unique((self.b_groups[b] - first) << 20 | self.b_ids[b], return_counts=True)
            of_left = left >> 20
            kinds = np.bincount(right >> 20, minlength=stop - first)
            start = np.cumsum(kinds) - kinds
            each = kinds[of_left]
            i, j = np.repeat(np.arange(len(left)), each), spans(start[of_left], each)
            document = np.searchsorted(group_ends, of_left[i] + first, "right")
            pair = (left[i] & 0xFFFFF) * size_b + (right[j] & 0xFFFFF)
            found.append(_summed(document << 31 | pair, left_n[i] * right_n[j]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        keys, n = found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found)))
        return keys >> 31, (keys & 0x7FFFFFFF).astype(np.int32), n

    def written(self, names) -> list[str]:
        """Groups of every document as `a1,a2|b1;a3|b2,b3`; `names` has the ids with each of the three signs."""
        comma, bar, semicolon = names
        groups = int(self.n_groups.sum())
        a_n, b_n = np.bincount(self.a_groups, minlength=groups), np.bincount(self.b_groups, minlength=groups)
        words = np.empty(len(self.a_ids) + len(self.b_ids), object)
        words[np.arange(len(self.a_ids)) + (np.cumsum(b_n) - b_n)[self.a_groups]] = np.where(
            np.append(np.diff(self.a_groups) > 0, True), bar[self.a_ids], comma[self.a_ids])
        words[np.arange(len(self.b_ids)) + np.cumsum(a_n)[self.b_groups]] = np.where(
            np.append(np.diff(self.b_groups) > 0, True), semicolon[self.b_ids], comma[self.b_ids])
        ends = self.a_ends + self.b_ends
        sizes = self.a_sizes + self.b_sizes
        return ["".join(words[end - size:end].tolist())[:-1] for end, size in zip(ends, sizes)]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their `n`."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


class _Align:
    """(id, text) to (id, ids and groups of A, ids and groups of B); groups are numbered from 0 in each document."""

    def __init__(self, tokenizers):
        self.tokenizers = tokenizers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = self.tokenizers.value
        tables = tokenizers.tables()
        for batch in pieces(batches, BLOCK_BYTES):
            block = Aligned(tokenizers, tables, [text or "" for text in batch.column(1).to_pylist()])
            first = np.cumsum(block.n_groups) - block.n_groups
            a_groups = block.a_groups - np.repeat(first, block.a_sizes)
            b_groups = block.b_groups - np.repeat(first, block.b_sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _lists(block.a_ids, block.a_sizes, pa.int32()), _lists(a_groups, block.a_sizes, pa.int32()),
                _lists(block.b_ids, block.b_sizes, pa.int32()), _lists(b_groups, block.b_sizes, pa.int32())],
                names=["id", "a_ids", "a_groups", "b_ids", "b_groups"])


class _Count:
    """(id, text) to a row per document and, marked `whole`, one per block; see `counted`."""

    def __init__(self, tokenizers):
        self.tokenizers = tokenizers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = self.tokenizers.value
        tables, size_b = tokenizers.tables(), len(tokenizers.b.lengths)
        ids = range(max(len(tokenizers.a.lengths), size_b))
        names = [np.array([f"{i}{sign}" for i in ids], object) for sign in ",|;"]
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, BLOCK_BYTES):
            block = Aligned(tokenizers, tables, [text or "" for text in batch.column(1).to_pylist()])
            document, pair, n = block.links(size_b)
            held = np.bincount(document, minlength=block.documents)
            totals = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(held)])]
            digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in block.written(names)]
            pairs, documents = np.unique(pair, return_counts=True)
            rows = batch.num_rows + 1
            integers = [np.append(column, 0) for column in (block.a_sizes, block.b_sizes, block.n_groups, np.diff(totals))]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, number)), pa.array(np.arange(rows) == rows - 1),
                pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)]),
                *(pa.array(column) for column in integers), pa.array([*digests, ""], pa.string()),
                _lists(np.append(pair, pairs), np.append(held, len(pairs)), pa.int32()),
                _lists(np.append(n, documents), np.append(held, len(pairs)), pa.int64()),
            ], names=["block", "whole", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])
            number += 1


class _Score:
    """The documents of a block and what the corpus knows of its pairs, to (..., n_best, count_sum)."""

    def __call__(self, documents: pa.Table, known: pa.Table) -> pa.Table:
        pair = known["pair"].to_numpy()
        order = np.argsort(pair)
        pair, docs, best = pair[order], known["docs"].to_numpy()[order], known["best"].to_numpy()[order]
        lists = documents["pairs"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        n = documents["counts"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        ends = np.append(0, np.cumsum(sizes))
        sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (n * best[at], n * docs[at])]
        names = ["id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(documents[name] for name in names), *map(pa.array, sums), documents["groups_sha256"]],
                        names=[*names, "n_best", "count_sum", "groups_sha256"])


def shared(spark: SparkSession, a_path: str, a_pattern: str, b_path: str):
    """Both tokenizers as a broadcast variable; its size is that of the files, not of the data."""
    ship_package(spark)
    return spark.sparkContext.broadcast(Tokenizers(a_path, a_pattern, b_path))


def align(docs: DataFrame, tokenizers, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, a_ids, a_groups, b_ids, b_groups)`: tokens of both sides and the group of each, numbered from 0."""
    inputs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    lists = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("a_ids", "a_groups", "b_ids", "b_groups")]
    return inputs.mapInArrow(_Align(tokenizers), T.StructType([inputs.schema["id"], *lists]))


def counted(docs: DataFrame, tokenizers, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged rows of documents with their distinct pairs and links, and of blocks with theirs and the documents."""
    inputs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("whole", T.BooleanType()),
        T.StructField("id", inputs.schema["id"].dataType),
        *(T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.LongType()))])
    return stage(inputs.mapInArrow(_Count(tokenizers), schema), "aligned")


def _entries(rows: DataFrame) -> DataFrame:
    return rows.filter("whole").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select(
        "block", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("docs"))


def pair_counts(rows: DataFrame, tokenizers) -> DataFrame:
    """`(pair, a, b, docs, best)` of what `counted` returns: documents that hold a pair, and whether no pair of its A id has more."""
    size_b = len(tokenizers.value.b.lengths)
    pairs = _entries(rows).groupBy("pair").agg(F.sum("docs").alias("docs"))
    pairs = pairs.withColumn("a", F.floor(F.col("pair") / size_b).cast("int")).withColumn("b", F.col("pair") % size_b)
    highest = F.max("docs").over(Window.partitionBy("a"))  # an id has at most as many pairs as B has ids
    return pairs.select("pair", "a", "b", "docs", (F.col("docs") == highest).alias("best"))


def report(docs: DataFrame, tokenizers) -> DataFrame:
    """Tokens, groups, links and corpus-wide counts of every document."""
    rows = counted(docs, tokenizers)
    known = _entries(rows).select("block", "pair").join(pair_counts(rows, tokenizers).select("pair", "docs", "best"), "pair")
    known = known.toDF("pair", "in_block", "docs", "best")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([rows.schema["id"], *(T.StructField(name, T.LongType()) for name in names),
                           T.StructField("groups_sha256", T.StringType())])
    score = _Score()
    scored = rows.filter("NOT whole").groupBy("block").cogroup(known.groupBy("in_block")).applyInArrow(
        lambda left, right: score(left, right), schema)
    return scored.select(F.col("id").alias("doc_id"), *names, "groups_sha256")

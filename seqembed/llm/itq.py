"""Near-duplicate embeddings by iterative quantisation, multi-index Hamming tables and a rerank.

1. A rotation is learned on a sample of at most `SAMPLE` vectors: principal axes, then turns that bring the
   sample closest to the corners of a cube, so that bits are balanced. The signs give each vector 64 bits.
2. The bits are cut into `TABLES` parts, each the key of a hash table. Two vectors are candidates when in some
   table their keys differ in one bit at most: every vector is filed under its key, and visits the keys that
   have one more bit set. Of the candidates those stay that differ in `MAX_BITS` bits at most, found only once.
3. Candidates are judged by the cosine of the original vectors in double precision.

Equal vectors of a label are one node. Tables are kept apart by label and length. A key with more than `CELL`
rows is cut into slices, and each pair of slices is a unit of work of its own. Vectors travel only with
candidates, of which nearly all are links. Links between clusters' vectors are listed, as their number is a result.

A pair at cosine 0.93 is found with a chance of about 0.97, closer ones nearly surely; the tests measure recall.

Vectors that are null, of length zero or with null or non-finite components, and those without a label, link with
nothing; so do vectors of different length. Repeated rows count as vectors of their own. Rows without an id take
part; they name a component only if no row of it has an id, and are never kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ship_package, stage
from .components import components

SAMPLE = 10_000
BITS = 64
TABLES = 5
MAX_BITS = 18
CELL = 16_384
SMALL = 48


class Codes:
    """The learned rotation of vectors of one length, and a drawn one for others."""

    def __init__(self, sample: np.ndarray, steps: int = 40):
        self.size = sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        width = min(BITS, self.size)
        axes = axes[:, ::-1][:, :width]
        low = centred @ axes
        turn = self._drawn(width, width)
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        self.rotation = axes @ turn
        if width < BITS:  # short vectors: further directions, drawn
            self.rotation = np.hstack([self.rotation, self._drawn(self.size, BITS - width)])

    @staticmethod
    def _drawn(rows: int, columns: int) -> np.ndarray:
        draw = np.random.default_rng(rows * 1000 + columns)
        if columns <= rows:
            return np.linalg.qr(draw.normal(size=(rows, columns)))[0]
        return draw.normal(size=(rows, columns))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of unit vectors of one length, as unsigned words."""
        if vectors.shape[1] == self.size:
            bits = (vectors - self.mean) @ self.rotation > 0
        else:
            bits = vectors @ self._drawn(vectors.shape[1], BITS) > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, offsets and norms of a list column without nulls."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64)
    offsets = offsets - offsets[0]
    return values, offsets, np.sqrt(np.add.reduceat(values * values, offsets[:-1])) if len(lists) else np.empty(0)


class _Code:
    """(node, label, embedding) to (node, label, size, code)."""

    def __init__(self, codes):
        self.codes = codes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets, norms = _unit(batch.column(2))
            sizes = np.diff(offsets)
            codes = np.zeros(batch.num_rows, np.uint64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                vectors = values[offsets[rows][:, None] + np.arange(size)] / norms[rows, None]
                codes[rows] = self.codes.value.of(vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)),
                                              pa.array(codes.view(np.int64))], names=["node", "label", "size", "code"])


def _masks() -> list[tuple[int, int]]:
    """First bit and width of each table's part."""
    ends = [BITS * i // TABLES for i in range(TABLES + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


class _Pairs:
    """Rows of cells, sorted, to candidates (a, b): in a table's key at most one bit differs."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 4 * CELL:
                continue
            table = [np.concatenate(c) for c in zip(*held)]
            last = np.logical_and.reduce([c == c[-1] for c in table[:6]])
            cut = int(np.argmax(last))
            if cut:
                yield from self._cells([c[:cut] for c in table])
            held, rows = [[c[cut:] for c in table]], rows - cut
        if held:
            yield from self._cells([np.concatenate(c) for c in zip(*held)])

    def _cells(self, table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        *unit, visits, second, node, code = table
        order = np.lexsort((second, *unit[::-1]))
        *unit, visits, second, node, code = (c[order] for c in table)
        number, i, j = unit[2], unit[4], unit[5]
        code, visits, second = code.view(np.uint64), visits.astype(bool), second.astype(bool)
        new = np.ones(len(node), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in unit])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(node))
        cell = np.cumsum(new) - 1
        size = ends - starts

        def kept(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            good = ~(visits[a] & visits[b]) & ((i[a] == j[a]) | (second[a] != second[b])) & (node[a] != node[b])
            a, b = a[good], b[good]
            differ = code[a] ^ code[b]
            near = np.bitwise_count(differ) <= MAX_BITS
            a, b, differ = a[near], b[near], differ[near]
            for table, (first, width) in enumerate(_masks()):  # only the first table that finds a pair reports it
                part = differ >> np.uint64(first) & np.uint64((1 << width) - 1)
                good = ~((np.bitwise_count(part) <= 1) & (number[a] > table))
                a, b, differ = a[good], b[good], differ[good]
            return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

        # Small cells all at once: each row with the next, the one after it, ...
        small = size[cell] <= SMALL
        for shift in range(1, min(SMALL, int(size.max()))):
            at = np.flatnonzero(small[:-shift] & (cell[shift:] == cell[:-shift]))
            if len(at):
                yield self._batch(kept(at, at + shift))
        for which in np.flatnonzero(size > SMALL):
            block = max(1, 2_000_000 // int(size[which]))
            for first in range(int(starts[which]), int(ends[which]), block):
                a = np.arange(first, min(first + block, int(ends[which])))
                b = np.arange(first + 1, int(ends[which]))
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
                yield self._batch(kept(a[a < b], b[a < b]))

    @staticmethod
    def _batch(pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def candidates(coded: DataFrame, cell: int = CELL) -> DataFrame:
    """`(a, b)`, a below b, each pair once: candidates of the staged `(node, label, size, code)`."""
    part = lambda first, width: F.expr(f"cast(shiftrightunsigned(code, {first}) & {(1 << width) - 1} as int)")
    entries = []
    for table, (first, width) in enumerate(_masks()):
        key = part(first, width)
        flips = F.filter(F.array(*[F.when(key.bitwiseAND(1 << bit) == 0, key.bitwiseOR(1 << bit)) for bit in range(width)]),
                         lambda k: k.isNotNull())
        entries += [_entries(F.array(key), table, False), _entries(flips, table, True)]
    rows = coded.select("label", "size", "node", "code", F.explode(F.concat(*entries)).alias("e")).select(
        "label", "size", F.col("e.number").alias("number"), F.col("e.key").alias("key"), "e.visits", "node", "code")
    bucket = ["label", "size", "number", "key"]
    # Only keys that fill a cell; there are at most rows / cell of them.
    hot = (rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > cell)
           .select(*bucket, F.ceil(F.col("n") / cell).cast("int").alias("slices")))
    hot = stage(hot, "hot")
    sliced = (rows.join(hot, bucket, "left") if hot.head(1) else rows.withColumn("slices", F.lit(None).cast("int")))
    sliced = sliced.withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    cells = sliced.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        *bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "visits",
        (F.col("own") > F.col("other")).alias("second"), "node", "code")
    unit = [*bucket, "i", "j"]
    return cells.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_Pairs(), "a long, b long")


def _entries(keys: Column, table: int, visits: bool) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(table).alias("number"), k.alias("key"), F.lit(visits).alias("visits")))


class _Judge:
    """(a, b, left, right) with vectors to (a, b) where the cosine is high enough."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, offsets, left_norms = _unit(batch.column(2))
            right, _, right_norms = _unit(batch.column(3))
            dots = np.add.reduceat(left * right, offsets[:-1])
            good = pa.array(dots / (left_norms * right_norms) >= self.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def links(nodes: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """`(a, b)`, each link once, between the staged `(node, label, embedding)`; embeddings are finite doubles."""
    spark = nodes.sparkSession
    ship_package(spark)
    rows = nodes.count()
    drawn = nodes if rows <= SAMPLE else nodes.filter(
        F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(0.9 * SAMPLE / rows * (1 << 20))))
    sample = [np.array(r.embedding) for r in drawn.select("embedding").limit(SAMPLE).toLocalIterator()]
    if not sample:
        return spark.createDataFrame([], "a long, b long")
    lengths, counts = np.unique([len(v) for v in sample], return_counts=True)
    usual = np.array([v / np.linalg.norm(v) for v in sample if len(v) == lengths[counts.argmax()]])
    codes = spark.sparkContext.broadcast(Codes(usual))
    coded = stage(nodes.select("node", "label", "embedding").mapInArrow(
        _Code(codes), T.StructType([T.StructField("node", T.LongType()), nodes.schema["label"],
                                    T.StructField("size", T.IntegerType()), T.StructField("code", T.LongType())])), "codes")
    found = stage(candidates(coded, cell), "pairs")
    left = nodes.select(F.col("node").alias("a"), F.col("embedding").alias("left"))
    right = nodes.select(F.col("node").alias("b"), F.col("embedding").alias("right"))
    judged = found.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return stage(judged.mapInArrow(_Judge(threshold), "a long, b long"), "links")


def report(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label", cell: int = CELL) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `vectors`."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"),
                          F.col(label_col).alias("label"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)  # null if a component is
    usable = F.coalesce(F.col("label").isNotNull() & (norm > 0) & (norm < float("inf")), F.lit(False))
    groups = rows.filter(usable).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = links(nodes, threshold, cell)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = nodes.select(F.col("node").alias("b"), "n")
    degrees = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    each = (nodes.select("node", "label", "embedding", "n", "least").join(degrees, "node", "left")
            .join(components(found, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    each = stage(each, "classes")
    total = each.groupBy("component").agg(F.min("least").alias("component_id"))
    known = each.join(total, "component").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

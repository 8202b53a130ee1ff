"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has a bit where more than half of the hashes of the text's shingles have it. Two
fingerprints link when at most `budget` bits differ.

The join walks pairs of trie nodes together, from the root down, one bit at a time. A pair carries the
bits in which its nodes differ so far, and is dropped when they exceed the error budget at that depth.
The trie is the sorted array of fingerprints; a node is a range of it.

A trie whose first bits may differ has nearly all pairs of nodes alive at its top. So the trie is built
`budget + 1` times, each time with the bits rotated by one more block. If two fingerprints differ in at
most `budget` bits, then in one of the rotations their first l blocks differ in at most l - 1 bits, for
every l: write the differing bits of each block less one around a circle; as they sum to less than zero,
all partial sums from some start on are below zero. So each trie has the error budget 0 after its first block, 1 after its
second, and so on, and no link is lost. The root splits by the first block, which is the shuffle key: each
fingerprint is sent once per rotation. Keys with more than `CELL` fingerprints are cut into slices, and
each pair of slices is a task unit of its own, so none outgrows a task.

Texts are fingerprinted once each, equal fingerprints are joined once, and each unit returns a spanning
forest of its links, so a group of copies makes no pairs. All links found are exact.

`keep_one` drops all but one document of each class by the same links.

Missing and empty texts have fingerprint 0 and link like any other; repeated rows share a fingerprint. A worker
holds some 20 bytes per byte of the longest text. An empty table gives no rows, and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import fresh, pieces, ship_package, stage
from .components import components, forest

BITS = 64
CELL = 50_000
FRONTIER = 400_000
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of all shingles of `size` words of a UTF-8 text; a shorter text is one shingle, an empty one has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[size - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def fingerprint_of(text: bytes, size: int, words: int = 1) -> np.ndarray:
    """Fingerprint of a UTF-8 text by shingles of `size` words, as unsigned words of 64 bits."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    out = np.empty(words, np.uint64)
    for word in range(words):
        if word:  # further words: the hashes mixed anew
            hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ hashes >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            hashes ^= hashes >> np.uint64(31)
        ones = np.zeros(BITS, np.int64)
        for first in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[first:first + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[word] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


class _Fingerprint:
    """Puts the words of the fingerprint, as longs, in place of the text in Arrow batches."""

    def __init__(self, text: int, size: int, words: int):
        self.text, self.size, self.words = text, size, words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = np.array([fingerprint_of(text or b"", self.size, self.words)
                               for text in batch.column(self.text).cast(pa.binary()).to_pylist()])
            columns = [pa.array(np.ascontiguousarray(values[:, word]).view(np.int64)) for word in range(self.words)]
            columns = [*batch.columns[:self.text], *batch.columns[self.text + 1:], *columns]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", words: int = 1) -> tuple[DataFrame, list[str]]:
    """`docs` with the fingerprint in place of the text, and the names of its columns, which are the last."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    rest = [field for i, field in enumerate(docs.schema.fields) if i != at]
    names = fresh(docs, "fingerprint", *[f"fingerprint{word}" for word in range(1, words)])
    schema = T.StructType([*rest, *[T.StructField(name, T.LongType()) for name in names]])
    return docs.mapInArrow(_Fingerprint(at, shingle, words), schema), names


def rotated(value: Column, by: int) -> Column:
    return value if by % BITS == 0 else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))


def block_ends(budget: int) -> list[int]:
    """Where each of the `budget + 1` blocks of bits ends."""
    return [BITS * (i + 1) // (budget + 1) for i in range(budget + 1)]


def allowed(budget: int, rotation: int) -> list[int]:
    """For each depth of a rotation the most bits that may differ above it."""
    ends = [0, *block_ends(budget)]
    sizes = [b - a for a, b in zip(ends, ends[1:])]
    sizes = sizes[rotation:] + sizes[:rotation]
    limits = []
    for block, size in enumerate(sizes):
        # Within a block, what is allowed at its end.
        limits += [block] * size
    return limits


def links(prints: DataFrame, names: list[str], node: str, budget: int = 4, all_budget: int | None = None,
          cell: int = CELL) -> DataFrame:
    """`(a, b)`: links of nodes whose components are those of all links.

    `prints` has distinct, staged fingerprints, a word of 64 bits in each of the columns `names`, and a number
    of its own in `node`. Nodes link if in some word at most `budget` bits differ, and in all words together
    at most `all_budget`.
    """
    ends = [0, *block_ends(budget)]
    others = [F.array(*[F.col(n) for n in names if n != name]) if len(names) > 1 else F.array().cast("array<bigint>")
              for name in names]
    turns = F.array(*[F.struct(F.lit(table * (budget + 1) + i).cast("int").alias("rotation"),
                               rotated(F.col(name), ends[i]).alias("v"),
                               F.lit(ends[i + 1] - ends[i]).cast("int").alias("width"), others[table].alias("rest"))
                      for table, name in enumerate(names) for i in range(budget + 1)])
    rest = [f"w{i}" for i in range(len(names) - 1)]
    rows = prints.select(F.col(node).alias("node"), F.explode(turns).alias("r")).select(
        "r.rotation", "r.v", F.expr("shiftrightunsigned(r.v, 64 - r.width)").alias("key"),
        "node", *[F.col("r.rest")[i].alias(w) for i, w in enumerate(rest)])
    # At most words * (budget + 1) * 2^block keys, and only those that need slices.
    hot = (rows.groupBy("rotation", "key").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
           .select("rotation", "key", F.ceil(F.col("n") / cell).cast("int").alias("slices")))
    sliced = rows.join(F.broadcast(hot), ["rotation", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    cells = sliced.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "rotation", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("second"), "v", "node", *rest)
    unit = ["rotation", "key", "i", "j"]
    return (cells.repartition(*unit).sortWithinPartitions(*unit, "second")
            .mapInArrow(_Join(budget, all_budget), "a long, b long"))


class _Join:
    """Sorted Arrow batches of (rotation, key, i, j, second, v, node, further words) to links (a, b)."""

    def __init__(self, budget: int, all_budget: int | None):
        self.limits = np.array([allowed(budget, r) for r in range(budget + 1)])
        self.all_budget = all_budget

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            held.append(table)
            rows += batch.num_rows
            if rows < 2 * CELL:
                continue
            table = [np.concatenate(column) for column in zip(*held)]
            last = np.ones(rows, bool)
            for column in table[:4]:
                last &= column == column[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from self._cells([column[:cut] for column in table])
                table = [column[cut:] for column in table]
            held, rows = [table], rows - cut
        if held:
            yield from self._cells([np.concatenate(column) for column in zip(*held)])

    def _cells(self, table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rotation, key, i, j, second, value, node, *wide = table
        order = np.lexsort((value.view(np.uint64), second, j, i, key, rotation))
        rotation, key, i, j, second, value, node, *wide = (x[order] for x in table)
        value = value.view(np.uint64)
        new = np.ones(len(value), bool)
        new[1:] = (rotation[1:] != rotation[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(value))
        middles = starts + np.add.reduceat((~second.astype(bool)).astype(np.int64), starts)
        alone = i[starts] == j[starts]
        left, right = [], []
        for turn in np.unique(rotation):
            here = rotation[starts] == turn
            a, b = trie_join(value, starts[here], middles[here], ends[here], alone[here],
                             self.limits[turn % len(self.limits)], [x.view(np.uint64) for x in wide], self.all_budget)
            left.append(a)
            right.append(b)
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return
        # A node in two units is two positions here; the distributed step joins them.
        label = forest(left, right, len(value))
        child = np.flatnonzero(label != np.arange(len(value)))
        yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["a", "b"])


def trie_join(value, starts, middles, ends, alone, limits, wide=(), all_budget=None):
    """Pairs of positions within budget, for each unit of a rotation.

    A unit that stands alone joins its range with itself, any other joins [start, middle) with
    [middle, end). Below the last bit, ranges of equal values are halved down to single positions.
    Many pairs are reduced to a forest on the way. The stack holds pieces of the frontier at some depth; the deepest is taken first,
    in pieces of at most `FRONTIER` pairs of nodes, so memory stays bounded whatever is alike.
    """
    ones: dict[int, np.ndarray] = {}

    def split(depth, low, high):
        """Where the right child of each node begins."""
        if depth >= BITS:
            return (low + high) // 2
        if depth not in ones:
            bit = (value >> np.uint64(BITS - 1 - depth)).astype(np.int64) & 1
            ones[depth] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
        return high - (ones[depth][high] - ones[depth][low])

    found_a, found_b = [], []
    own = alone & (ends - starts > 1)
    cross = ~alone & (middles > starts) & (ends > middles)
    stack = [(0, starts[own], ends[own], starts[own], ends[own], np.zeros(own.sum(), np.int8)),
             (0, starts[cross], middles[cross], middles[cross], ends[cross], np.zeros(cross.sum(), np.int8))]
    while stack:
        depth, al, ah, bl, bh, differ = stack.pop()
        if not len(al):
            continue
        if len(al) > FRONTIER:
            for first in range(0, len(al), FRONTIER):
                stack.append((depth, *(x[first:first + FRONTIER] for x in (al, ah, bl, bh, differ))))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            # Two leaves: the remaining budgets are those of the whole path.
            a, b = al[single], bl[single]
            near = np.bitwise_count(value[a] ^ value[b]) <= limits[-1]
            a, b = a[near], b[near]
            if all_budget is not None:
                bits = np.bitwise_count(value[a] ^ value[b]).astype(np.int16)
                for word in wide:
                    bits += np.bitwise_count(word[a] ^ word[b])
                a, b = a[bits <= all_budget], b[bits <= all_budget]
            found_a.append(a)
            found_b.append(b)
            if len(found_a) > 64 and sum(map(len, found_a)) > FRONTIER:
                label = forest(np.concatenate(found_a), np.concatenate(found_b), len(value))
                child = np.flatnonzero(label != np.arange(len(value)))
                found_a, found_b = [child], [label[child]]
            al, ah, bl, bh, differ = (x[~single] for x in (al, ah, bl, bh, differ))
            if not len(al):
                continue
        am, bm = split(depth, al, ah), split(depth, bl, bh)
        same = al == bl
        parts = []
        for one, (cl, ch, dl, dh) in ((0, (al, am, bl, bm)), (0, (am, ah, bm, bh)), (1, (al, am, bm, bh)), (1, (am, ah, bl, bm))):
            one = one if depth < BITS else 0
            keep = (ch > cl) & (dh > dl) & (differ + one <= limits[min(depth, BITS - 1)])
            if cl is am and dl is bl:
                keep &= ~same  # a node with itself has its children cross once
            parts.append(tuple(x[keep] for x in (cl, ch, dl, dh)) + (differ[keep] + np.int8(one),))
        # A leaf with itself is no pair.
        child = [np.concatenate(x) for x in zip(*parts)]
        pair = ~((child[0] == child[2]) & (child[1] - child[0] == 1))
        stack.append((depth + 1, *(x[pair] for x in child)))
    empty = np.empty(0, np.int64)
    return (np.concatenate(found_a) if found_a else empty), (np.concatenate(found_b) if found_b else empty)


def report(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row of `docs`.

    The component is the smallest id reachable. A row without an id takes part, and does not name a
    component unless none of its rows has an id; then the component is missing too.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints, names = fingerprints(source, shingle)
    prints = stage(prints, "prints")
    each = prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", F.col(names[0]))
    each = classes(stage(each, "nodes"), names, budget)
    total = each.groupBy("component").agg(F.min("least").alias("component_id"))
    each = each.select(*names, "component").join(total, "component")
    return prints.join(each, names).select(
        "doc_id", F.lpad(F.lower(F.hex(names[0])), 16, "0").alias("fingerprint"), "component_id")


def classes(nodes: DataFrame, names: list[str], budget: int, all_budget: int | None = None) -> DataFrame:
    """Staged `nodes`, distinct fingerprints with a number `node`, with the `component` of each."""
    found = components(links(nodes, names, "node", budget, all_budget), "a", "b")
    return stage(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")


def keep_one(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` less all but one row of each component of linked fingerprints, same columns.

    The row that stays has the smallest id of its component; of several such rows any one stays. Rows
    without an id stay only where no row of the component has one.
    """
    (row,) = fresh(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    source = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, names = fingerprints(source, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")  # missing ids last
    nodes = prints.groupBy(*names).agg(first).withColumn("node", F.col(names[0]))
    each = classes(stage(nodes, "nodes"), names, budget)
    best = each.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(best, row, "left_semi").select(*docs.columns)

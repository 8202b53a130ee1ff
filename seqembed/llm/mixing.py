"""Language-model scores by online logistic context mixing.

A text is its UTF-8 bytes and an end mark, the byte FF, which no text has. A byte is a path of yes-or-no
decisions in a binary tree. There is a tree for each last byte, built by Huffman's rule from what follows it in
the training texts, so usual bytes take few decisions.

Each decision is predicted from several contexts: the last two bytes, the last three, the word so far, and the
word so far with the word before. A context and a tree node are hashed to a slot that counts both outcomes over all
training texts. Slots are counted per partition, merged block by block in levels of `FAN` partitions, and broadcast
as logits. The tables grow with the training bytes, from 5.8 million slots up to four times as many, which bounds the
broadcast; beyond, contexts share slots. Word counts, behind the base score, grow without bound, as a table of Spark.

A gate picks a set of weights: how far the word has come, and how often the two longest contexts have been seen
before. The weighted sum of the logits is the logit of the mix. Weights start from a logistic regression on every decision
of all training texts, one Newton step from `FIRST`, in which each decision is left out of its own counts; partitions
send sums of a fixed size. In each text weights are then learned on, after 32 bytes, 64, 128 and so on up to every
`BLOCK`, and a further adaptive map from the mixed logit to what really happened refines the outcome. Nothing carries
over from one text to another, so scores do not depend on how rows are dealt out. Texts are worked off in runs whose
decisions fit the caches, and a slot's logit and how often it has been seen are read at once.

The base score is that of single words with add-one smoothing; with `fold` they are compared with A-Z in lower case,
while the model always scores the bytes as they are. Words are counted by 64 bits of hash; the `FREQUENT`
most frequent ones are broadcast, all others are joined.

Missing texts are empty, and empty texts have their end mark alone. Repeated rows are counted and scored each on
its own. Without training texts every decision has probability 1/2, and without rows there is no result. Texts of more
than `SEGMENT` bytes are counted and scored in parts, cut at white space, each with the `LEAD` bytes before it as
context and the weights as they were; a worker holds some hundred bytes per byte of a part, and of the longest word.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import spans
from .common import pieces, remainder, ship_package, stage
from .substrings import Words, _mix, _powers

SLOT_BITS = (19, 20, 21, 21)
TABLES = len(SLOT_BITS)
OFFSETS = np.concatenate([[0], np.cumsum([1 << bits for bits in SLOT_BITS])])
FIRST_GROWTH, MOST_GROWTH = 29, 2  # tables double at 2^29 training bytes, and so often
MERGE = 1 << 16
FAN = 256
DEPTHS, SEEN = 4, 4
GATES = DEPTHS * SEEN * SEEN
FIRST = 0.3
BLOCK = 4096
RUN, CACHED = 8192, 1 << 15  # bytes of which what is known of decisions, and of contexts, fits the caches
SEGMENT = 1 << 18
LEAD = 512
_STEPS = np.array([0, *(1 << np.arange(5, 12))])  # where the first steps of a text begin, up to BLOCK
RATE = 0.02
FREQUENT = 1 << 18
END = 255
_NODE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SMALL, _LARGE = np.float32(2.0 ** -95), np.float32(2.0 ** 95)  # counts of 31 bits give logits of 2^-31 to 2^5
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32, END]] = True


class Trees:
    """Paths of all bytes after each last byte: nodes, unique over all trees, and outcomes, one path after the other.

    `counts` has how often a byte followed the last one, as `counts[last * 256 + byte]`.
    """

    def __init__(self, counts: np.ndarray):
        lengths, nodes, bits = [], [], []
        for last in range(256):
            for path in self._paths(counts[last * 256:(last + 1) * 256].tolist()):
                lengths.append(len(path))
                nodes += [last << 8 | node for node, _ in path]
                bits += [bit for _, bit in path]
        self.lengths = np.array(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.nodes, self.bits = np.array(nodes, np.uint16), np.array(bits, bool)
        self.marks = self.nodes.astype(np.uint64) * _NODE * _SPREAD

    def decisions(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the given bytes each decision belongs to, the mark of its node, and its outcome."""
        lengths = self.lengths.take(pair)
        byte = np.repeat(np.arange(len(pair)), lengths)
        index = (self.starts.take(pair) - (np.cumsum(lengths) - lengths)).take(byte)
        index += np.arange(len(index))
        return byte, self.marks.take(index), self.bits.take(index)

    @staticmethod
    def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
        heap = [(n + 1, byte) for byte, n in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            (low, left), (high, right) = heapq.heappop(heap), heapq.heappop(heap)
            above[left], above[right] = (node, 0), (node, 1)
            heapq.heappush(heap, (low + high, node))
            node += 1
        paths = []
        for byte in range(256):
            path, at = [], byte
            while at in above:
                at, bit = above[at]
                path.append((at - 256, bit))
            paths.append(path[::-1])
        return paths


_WHITE = re.compile(rb"[\x09-\x0D\x20]")
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)
Part = tuple[bytes, int, bool]


def parts_of(text: bytes) -> Iterator[Part]:
    """A text in parts of about `SEGMENT` bytes, cut after white space: bytes, how many of them are the lead, whether it is the last."""
    at = lead = 0
    while len(text) - at > SEGMENT and (white := _WHITE.search(text, at + SEGMENT)):
        yield text[at - lead:white.end()], lead, False
        at = white.end()
        lead = min(LEAD, at)
    yield text[at - lead:], lead, True


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


class Contexts:
    """Hashed contexts, last and next byte, depth of the word, part and place of every byte to predict.

    A context takes the upper 48 bits of a word whose lower 16 are left for the last and the next byte. `four` has the
    last three bytes and the next one, unhashed.
    """

    def __init__(self, parts: list[Part]):
        columns = []
        begin = size = 0
        for i, (data, _, _) in enumerate(parts, 1):
            size += len(data) + 1
            if size >= CACHED or i == len(parts):
                columns.append(self._columns(parts[begin:i], begin))
                begin, size = i, 0
        columns = columns[0] if len(columns) == 1 else [np.concatenate(column) for column in zip(*columns or [self._columns([], 0)])]
        self.pair, self.part, self.place, self.depth, self.four, *self.hashes = columns

    @staticmethod
    def _columns(parts: list[Part], number: int) -> list[np.ndarray]:
        # An end mark before the first part and after each.
        flat = np.frombuffer(b"\xff".join([b"", *(data for data, _, _ in parts), b""]), np.uint8)
        sizes = np.array([len(data) + 1 for data, _, _ in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        one = flat[:-1]
        two, three = np.full((2, len(one)), END, np.uint8)
        two[1:], three[2:] = flat[:-2], flat[:-3]
        two[one == END] = END
        three[two == END] = END
        place = np.arange(len(one), dtype=np.int32)
        space = _SPACES[flat]
        start = np.maximum.accumulate(np.where(space[:-1], place, 0))  # where the word began
        up, down = _powers[0].take(len(flat) + 1)
        sums = np.zeros(len(one) + 1, np.uint64)
        np.cumsum((one.astype(np.uint64) + np.uint64(1)) * up[:len(one)], out=sums[1:])
        word = sums[1:] - sums[1:].take(start)
        word *= down.take(start)
        depth = place - start
        so_far = _mix(word + depth.astype(np.uint64))
        # The word before, in the same part, is the word so far where it ended.
        last = np.maximum.accumulate(np.where(~space[:-1] & space[1:], place, -1)).take(start)
        before = so_far.take(np.maximum(last, 0))
        before *= last >= np.repeat(first, sizes)
        wide = one.astype(np.uint64) | two.astype(np.uint64) << np.uint64(8)
        inside = place - np.repeat(first + [lead for _, lead, _ in parts], sizes)
        pair = one.astype(np.uint32) << np.uint32(8) | flat[1:]
        columns = [pair.astype(np.int64), np.repeat(np.arange(number, number + len(parts), dtype=np.int32), sizes), inside,
                   np.minimum((depth + 1) // 2, DEPTHS - 1),
                   pair | two.astype(np.uint32) << np.uint32(16) | three.astype(np.uint32) << np.uint32(24),
                   *((context * _SPREAD) & _HIGH
                     for context in (wide, wide | three.astype(np.uint64) << np.uint64(16), so_far, _mix(so_far + np.uint64(3) * before)))]
        if all(whole and not lead for _, lead, whole in parts):
            return columns
        wanted = inside >= 0
        wanted[(first + sizes - 1)[[not whole for _, _, whole in parts]]] = False
        return [column[wanted] for column in columns]


class Shape:
    """Where each table begins and how wide it is, after so many doublings."""

    def __init__(self, growth: int = 0):
        self.bits = [bits + growth for bits in SLOT_BITS]
        self.offsets = OFFSETS << growth

    @classmethod
    def of(cls, training_bytes: int) -> Shape:
        return cls(max(0, min(MOST_GROWTH, int(training_bytes).bit_length() - FIRST_GROWTH)))

    def slots(self, table: int, hashes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Slots of contexts and nodes."""
        return self.places(table, hashes * _SPREAD, nodes * _SPREAD)

    def places(self, table: int, spread: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Slots of contexts and nodes that are multiplied by `_SPREAD` already; `spread` is overwritten."""
        spread += marks
        spread >>= np.uint64(64 - self.bits[table])
        slots = spread.view(np.int64)
        slots += self.offsets[table]
        return slots


class Decisions:
    """All decisions of a run of parts: slots by table, outcomes and depths of the word."""

    def __init__(self, parts: list[Part], trees: Trees, shape: Shape):
        found = Contexts(parts)
        byte, marks, self.outcome = trees.decisions(found.pair)
        self.depth = found.depth.take(byte)
        self.slots = [shape.places(table, (hashes * _SPREAD).take(byte), marks) for table, hashes in enumerate(found.hashes)]


def often(counts: np.ndarray) -> np.ndarray:
    """How often a slot has been seen, in `SEEN` classes: never, once, a few times, more."""
    return ((counts > 0).astype(np.uint8) + (counts > 1) + (counts > 6)).astype(np.uint8)


def gate_of(depth: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (depth * SEEN + word) * SEEN + pair


class _Count:
    """Arrow batches of (text) to blocks of slot counts (block, part, zeros, ones), compressed; part is that of the partition."""

    def __init__(self, trees, shape: Shape):
        self.trees, self.shape = trees, shape

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, trees = self.shape, self.trees.value
        pairs = np.zeros(2 * shape.offsets[-1], np.int32)
        held, size = [], 0
        for batch in pieces(batches, 1 << 20):
            for text in texts_of(batch.column(0)):
                for part in parts_of(text):
                    held.append(part)
                    size += len(part[0])
                    if size >= SEGMENT:
                        self._add(pairs, held, trees)
                        held, size = [], 0
        if held:
            self._add(pairs, held, trees)
        number = TaskContext.get().partitionId() if TaskContext.get() else 0
        for block in range(0, shape.offsets[-1], MERGE):
            part = pairs[2 * block:2 * (block + MERGE)].reshape(-1, 2).T
            if part.any():
                packed = [_packed(np.ascontiguousarray(p)) for p in part]
                yield pa.RecordBatch.from_arrays([pa.array([block // MERGE], pa.int32()), pa.array([number], pa.int32()),
                                                  *(pa.array([p], pa.binary()) for p in packed)],
                                                 names=["block", "part", "zeros", "ones"])

    def _add(self, pairs: np.ndarray, parts: list[Part], trees: Trees) -> None:
        """Count each different context and byte once, with how often it came."""
        found = Contexts(parts)
        keys, counts = np.unique(found.four, return_counts=True)
        pair, three = (keys & np.uint32(0xFFFF)).astype(np.int64), keys.astype(np.uint64) >> np.uint64(8)
        for table, context in ((0, three & np.uint64(0xFFFF)), (1, three)):
            self._count(pairs, table, (context * _SPREAD) & _HIGH, pair, counts, trees)
        for table in range(2, TABLES):
            keys, counts = np.unique(found.hashes[table] | found.pair.view(np.uint64), return_counts=True)
            self._count(pairs, table, keys & _HIGH, (keys & ~_HIGH).view(np.int64), counts, trees)

    def _count(self, pairs: np.ndarray, table: int, hashes: np.ndarray, pair: np.ndarray, counts: np.ndarray, trees: Trees) -> None:
        spread, counts = hashes * _SPREAD, counts.astype(np.int32)
        for low in range(0, len(pair), RUN):
            run = slice(low, low + RUN)
            key, nodes, bits = trees.decisions(pair[run])
            slots = self.shape.places(table, spread[run].take(key), nodes)
            slots <<= 1
            slots += bits
            np.add.at(pairs, slots, counts[run].take(key))


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.stack([(counts >> shift).astype(np.uint8) for shift in (0, 8, 16, 24)]), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    counts = planes[3].astype(np.int32)
    for plane in planes[2::-1]:
        counts <<= 8
        counts |= plane
    return counts


def _merge(table: pa.Table) -> pa.Table:
    """The counts of a block, over a bounded number of partitions."""
    out = []
    for name in ("zeros", "ones"):
        total = np.zeros(MERGE, np.int64)
        for data in table.column(name):
            total += _unpacked(data.as_py())
        out.append(pa.array([_packed(np.minimum(total, 2**31 - 1).astype(np.int32))], pa.binary()))
    return pa.table([table.column("block").slice(0, 1), table.column("part").slice(0, 1), *out], names=["block", "part", "zeros", "ones"])


def merged(counts: DataFrame, partitions: int, fan: int = FAN) -> DataFrame:
    """Counts `(block, part, zeros, ones)` with one row per block; a task merges `fan` rows of a block at most at a time."""
    while True:
        counts = counts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("block", "part").applyInArrow(
            _merge, "block int, part int, zeros binary, ones binary")
        partitions = -(-partitions // fan)
        if partitions <= 1:
            return counts


def _logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), dtype=np.float32)


def _marked(logits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Logits with a class of `SEEN`, so both are read at once: it takes two bits of the exponent that logits of counts never need."""
    return (logits * _SMALL).view(np.uint32) | seen.astype(np.uint32) << np.uint32(29)


def _unmarked(marked: np.ndarray) -> np.ndarray:
    return (marked & np.uint32(0x9FFFFFFF)).view(np.float32) * _LARGE


def _marks(marked: np.ndarray) -> np.ndarray:
    return marked >> np.uint32(29) & np.uint32(SEEN - 1)


class Model:
    """Trees, logits of all slots and how often they have been seen, and first weights."""

    def __init__(self, trees: Trees, logits: np.ndarray, seen: np.ndarray, weights: np.ndarray, shape: Shape = Shape()):  # noqa: B008
        self.trees, self.marked, self.weights, self.shape = trees, _marked(logits, seen), weights, shape

    @cached_property
    def logits(self) -> np.ndarray:
        return _unmarked(self.marked)

    @cached_property
    def seen(self) -> np.ndarray:
        return _marks(self.marked).astype(np.uint8)

    def score(self, column: pa.Array) -> np.ndarray:
        """Natural logarithm of the probability of each text."""
        data = texts_of(column)
        order = sorted(range(len(data)), key=lambda text: -len(data[text]))  # texts that end in the same step are neighbours
        state = _State(self.weights, len(data))
        ways = [parts_of(data[text]) for text in order]
        texts, going_on = np.arange(len(ways)), False
        while len(texts):
            parts = [next(ways[text]) for text in texts]
            self._advance(state, texts, parts, going_on)
            texts, going_on = texts[[not whole for _, _, whole in parts]], True
        total = np.empty(len(data))
        total[order] = state.total
        return total

    def _advance(self, state: _State, texts: np.ndarray, parts: list[Part], going_on: bool) -> None:
        """Score the next part of each text, and learn from it step by step, in runs of texts that fit the caches.

        Parts that go on with a text have long steps from the start. Nothing is learned from the last step of a text.
        """
        found = Contexts(parts)
        sizes = np.bincount(found.part, minlength=len(parts))
        first = np.cumsum(sizes) - sizes
        whole = np.array([whole for _, _, whole in parts])
        spread = [hashes * _SPREAD for hashes in found.hashes]
        low, most = 0, sizes.max()
        while low < most:
            high = low + BLOCK if going_on or low >= BLOCK else int(_STEPS[_STEPS > low].min(initial=BLOCK))
            here = np.flatnonzero(sizes > low)
            many, ends = np.minimum(sizes[here], high) - low, whole[here] & (sizes[here] <= high)
            for begin, end in _runs(many, ends):
                place = spans(first[here[begin:end]] + low, many[begin:end])
                self._step(state, texts[here[begin:end]], many[begin:end], found.pair.take(place), found.depth.take(place),
                           [hashes.take(place) for hashes in spread], not ends[begin])
            low = high

    def _step(self, state: _State, texts: np.ndarray, many: np.ndarray, pair: np.ndarray, depth: np.ndarray,
              spread: list[np.ndarray], learn: bool) -> None:
        """Score the next bytes of some texts, so many of each, with the weights as they are, and then learn from them."""
        n = len(texts)
        byte, marks, y = self.trees.decisions(pair)
        text = np.repeat(np.arange(n), many)
        starts = np.searchsorted(byte, np.cumsum(many) - many)
        marked = [self.marked.take(self.shape.places(table, hashes.take(byte), marks)) for table, hashes in enumerate(spread)]
        row = (depth * (SEEN * SEEN) + text * GATES).take(byte)
        row += _marks(marked[-2]) * np.uint32(SEEN) + _marks(marked[-1])
        x = [_unmarked(column) for column in marked]
        weights = [w[texts] for w in state.weights]
        flat = [w.reshape(-1) for w in weights]
        logit = flat[TABLES].take(row)
        for w, column in zip(flat, x):
            logit += w.take(row) * column
        np.clip(logit, -12, 12, out=logit)
        p = 1 / (1 + np.exp(-logit))
        cell = np.clip(logit, -7.999, 7.999) * 2 + 16
        left = cell.astype(np.int64)
        right = cell - left
        left += (text * 33).take(byte)
        refined = ((state.prior * 24 + state.happened[texts]) / (24 + state.seen[texts])).astype(np.float32).reshape(-1)
        value = refined.take(left)
        value += (refined.take(left + 1) - value) * right
        final = (value + p) * np.float32(0.5)
        chance = np.maximum(np.abs(final - ~y), np.float32(1e-6))
        state.total[texts] += np.add.reduceat(np.log(chance), starts, dtype=np.float64)
        if not learn:
            return
        error = y - p
        rate = RATE / np.sqrt(np.maximum(np.bincount(row, minlength=n * GATES), 1))
        for w, column in zip(flat, x):
            w += (rate * np.bincount(row, error * column, n * GATES)).astype(np.float32)
        flat[TABLES] += (rate * np.bincount(row, error, n * GATES)).astype(np.float32)
        for old, new in zip(state.weights, weights):
            old[texts] = new
        left += right >= 0.5
        state.seen[texts] += np.bincount(left, minlength=n * 33).reshape(n, 33)
        state.happened[texts] += np.bincount(left, y, n * 33).reshape(n, 33)


def _runs(many: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts with `RUN` bytes or few more in all, of which either all end or none."""
    begin = size = 0
    for i, (n, last) in enumerate(zip(many.tolist(), ends.tolist())):
        if i > begin and (size >= RUN or last != ends[begin]):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(many):
        yield begin, len(many)


class _State:
    """What is learned in each text: weights by gate and table, and the map of outcomes; and its score so far."""

    def __init__(self, weights: np.ndarray, n: int):
        self.weights = [np.tile(w.astype(np.float32), (n, 1)) for w in weights.T]
        self.prior = 1 / (1 + np.exp(-np.linspace(-8, 8, 33)))
        self.seen, self.happened = np.zeros((n, 33)), np.zeros((n, 33))
        self.total = np.zeros(n)


def left_out(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logits of a slot without one zero, and without one of its ones, marked with how often it has been seen then, by slot."""
    out = np.empty((len(zeros), 2), np.uint32)
    for low in range(0, len(zeros), MERGE):
        part = slice(low, low + MERGE)
        seen = often(zeros[part] + ones[part] - 1)
        out[part, 0] = _marked(_logit(np.maximum(zeros[part] - 1, 0), ones[part]), seen)
        out[part, 1] = _marked(_logit(zeros[part], np.maximum(ones[part] - 1, 0)), seen)
    return out.reshape(-1)


def curves(parts: list[Part], trees: Trees, zeros: np.ndarray, ones: np.ndarray, shape: Shape) -> np.ndarray:
    """Sums by gate over all decisions, each left out of its counts: the curvature of the loss at `FIRST`, and its slope last."""
    return _curves(parts, trees, left_out(zeros, ones), shape)


def _curves(parts: list[Part], trees: Trees, logits: np.ndarray, shape: Shape) -> np.ndarray:
    """Sums of `curves`, from logits of `left_out`."""
    decisions = Decisions(parts, trees, shape)
    y = decisions.outcome
    sums = np.zeros((GATES, TABLES + 1, TABLES + 2))
    if not len(y):
        return sums
    # Terms are whole multiples of small powers of two, so their sums are the same however rows are dealt out.
    x, seen, one = [], [], y.astype(np.int64)
    for slots in decisions.slots:
        slots <<= 1
        slots += one
        marked = logits.take(slots)
        x.append(_unmarked(marked))
        seen.append(_marks(marked))
    gates = gate_of(decisions.depth, *seen[-2:]).astype(np.uint8)
    logit = x[0] + x[1]
    for column in x[2:TABLES]:
        logit += column
    p = 1 / (1 + np.exp(-np.clip(logit * np.float32(FIRST), -30, 30)))
    order = np.argsort(gates, kind="stable")
    ends = np.cumsum(np.bincount(gates, minlength=GATES)).tolist()
    # Inputs, and inputs by curvature with the slope, in the order of the gates, as whole numbers.
    left, right = np.empty((2, TABLES + 2, len(y)))
    for row, column in zip(left, x):
        row[:] = np.rint(column.take(order) * np.float32(64))
    left[TABLES] = 64
    right[-1] = np.rint((p * (1 - p)).take(order) * np.float32(1024))
    np.multiply(left[:-1], right[-1], out=right[:-1])
    right[-1] = np.rint((y - p).take(order) * np.float32(1024))
    for gate, low, high in zip(range(GATES), [0, *ends], ends):
        if low < high:
            sums[gate] = left[:-1, low:high] @ right[:, low:high].T
    sums[:, :, :-1] /= 64 * 64 * 1024
    sums[:, :, -1] /= 64 * 1024
    return sums


def moved(sums: np.ndarray) -> np.ndarray:
    """Weights by gate, one Newton step from `FIRST`."""
    weights = np.full((GATES, TABLES + 1), FIRST)
    weights[:, TABLES] = 0
    return weights + np.linalg.solve(sums[:, :, :-1] + np.eye(TABLES + 1), sums[:, :, -1:])[:, :, 0]


def first_weights(texts: list[bytes], trees: Trees, zeros: np.ndarray, ones: np.ndarray, shape: Shape) -> np.ndarray:
    """Weights learned from texts that are at hand."""
    return moved(sum(curves([(text, 0, True)], trees, zeros, ones, shape) for text in texts))


class _Curves:
    """Arrow batches of (text) to the sums of the partition (cell, value)."""

    def __init__(self, known, shape: Shape):
        self.known, self.shape = known, shape

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, logits = self.known.value
        sums, held, size = np.zeros((GATES, TABLES + 1, TABLES + 2)), [], 0
        for batch in pieces(batches, 1 << 20):
            for text in texts_of(batch.column(0)):
                for part in parts_of(text):
                    held.append(part)
                    size += len(part[0])
                    if size >= 2 * RUN:
                        sums += _curves(held, trees, logits, self.shape)
                        held, size = [], 0
        if held:
            sums += _curves(held, trees, logits, self.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["cell", "value"])


class _Tokens:
    """Arrow batches of (text) to counts (kind, key, n): kind 0 by hash of a word, kind 1 by last byte and byte, kind 2 of texts."""

    def __init__(self, fold: bool):
        self.fold = fold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):
            words = Words(batch.column(0), self.fold)
            keys, counts = np.unique(words.hashes, return_counts=True)
            data = words.data.copy()
            data[words.edges] = END
            pairs = np.bincount(data[:-1].astype(np.int64) << 8 | data[1:])
            used = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([0, 1, 2], np.int8), [len(keys), len(used), 1])),
                pa.array(np.concatenate([keys.view(np.int64), used, [0]])),
                pa.array(np.concatenate([counts, pairs[used], [batch.num_rows]]))], names=["kind", "key", "n"])


class _Score:
    """(row, doc_id, held_out, text) to the model's score and what is known of the words without the rare ones."""

    def __init__(self, model, frequent, fold: bool):
        self.model, self.frequent, self.fold = model, frequent, fold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        keys, logs = self.frequent.value
        for batch in pieces(batches, 3 << 17):
            words = Words(batch.column(3), self.fold)
            n = np.diff(words.first)
            text = np.repeat(np.arange(batch.num_rows), n)
            at = np.minimum(np.searchsorted(keys, words.hashes), max(len(keys) - 1, 0))
            hit = keys[at] == words.hashes if len(keys) else np.zeros(len(words.hashes), bool)
            base = np.bincount(text[hit], logs[at[hit]], batch.num_rows) if len(keys) else np.zeros(batch.num_rows)
            rare = words.hashes[~hit].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=batch.num_rows))])
            score = model.score(batch.column(3)) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n + 1), pa.array(np.bincount(text[hit], minlength=batch.num_rows)), pa.array(base.astype(np.float64)),
                 pa.array(score), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "score", "rare"])


def fit(training: DataFrame, tokens: DataFrame) -> Model:
    """The model of the texts in `training`, whose only column is text; `tokens` are their counts."""
    follows = np.zeros(1 << 16, np.int64)
    for r in tokens.filter("kind = 1").collect():  # a row for each pair of bytes at most
        follows[r.key] = r.n
    trees, shape = Trees(follows), Shape.of(int(follows.sum()))
    counts = training.mapInArrow(_Count(training.sparkSession.sparkContext.broadcast(trees), shape),
                                 "block int, part int, zeros binary, ones binary")
    zeros, ones = np.zeros(shape.offsets[-1], np.float32), np.zeros(shape.offsets[-1], np.float32)
    for r in merged(counts, training.rdd.getNumPartitions()).toLocalIterator():  # as many blocks as the tables have
        part = slice(r.block * MERGE, (r.block + 1) * MERGE)
        zeros[part], ones[part] = _unpacked(r.zeros), _unpacked(r.ones)
    shared = training.sparkSession.sparkContext.broadcast((trees, left_out(zeros, ones)))
    sums = np.zeros((GATES, TABLES + 1, TABLES + 2))
    for r in training.mapInArrow(_Curves(shared, shape), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        sums.flat[r.cell] = r.value  # as many rows as `sums` has cells
    shared.unpersist()
    weights = moved(sums)
    seen = often(zeros + ones)
    return Model(trees, _logit(zeros, ones), seen, weights, shape)


def report(docs: DataFrame, modulus: int = 7, held: int = 2, fold: bool = False) -> DataFrame:
    """Scores of every row of `docs`, learned from those whose id's crc32 modulo `modulus` is not `held`."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"),
                         F.coalesce("text", F.lit("")).alias("text"))
    training = source.filter("NOT held_out").select("text")
    tokens = stage(training.mapInArrow(_Tokens(fold), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "tokens")
    words = tokens.filter("kind = 0").select("key", "n")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = tokens.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train, v_train = whole.n + texts, whole.v + (1 if texts else 0)
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.log10(top["n"].to_numpy(np.float64)[order] + 1)))
    model = spark.sparkContext.broadcast(fit(training, tokens))
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = stage(numbered.mapInArrow(_Score(model, frequent, fold), T.StructType([
        T.StructField("row", T.LongType()), source.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_frequent", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))])), "scored")
    rest = scored.select("row", F.explode("rare").alias("key")).join(words, "key").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("n_rare"))
    ending = 1 if texts else 0
    base = (F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(texts + 1))
            - F.col("n_tokens") * float(np.log10(n_train + v_train + 1)))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + ending).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

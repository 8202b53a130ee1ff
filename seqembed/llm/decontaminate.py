"""Benchmark decontamination with a generalised suffix automaton.

Texts are normalised to words: A-Z in lower case, everything else below U+0080 but digits and letters
separates. The automaton holds every run of words of every test item. Reading the words of a document,
it keeps the longest match that ends at each word. A match of `window` words or more makes its words hit,
and the state of the last `window` words tells which items contain them. An item of fewer words is one
window of its own length.

A document is only walked where `window` neighbouring words could match at all: all of them words of
the benchmark, and each pair of neighbours a pair of the benchmark, by a hashed bitmap.

The benchmark is cut into blocks of about `BLOCK_WORDS` words, so an automaton has a proven size whatever
the benchmark grows to. Documents are read once for each block, and hits are merged on the row, without a join.

Missing and empty texts have no words. Repeated rows are marked each on its own, and repeated items
count once by id. Missing item ids count as the empty text. Long texts are walked whole, in pieces of `PIECE_WORDS`
words; a worker holds their words. Without documents there are no rows, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, pieces, sha256_hex, ship_package, stage

BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000
_PAIR_BITS = 22
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = T.ArrayType(T.ArrayType(T.IntegerType()))


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_TABLE).split()


def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


class Automaton:
    """Generalised suffix automaton over the words of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.shortest = window
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words]
            coded.append((name, ids))
            self.shortest = min(self.shortest, len(ids))
            array = np.array(ids, np.int64)
            self.pairs[_pair_slot(array[:-1], array[1:])] = True
            last = 0
            for word in ids:
                last = self._extend(last, word)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        # The suffix of `window` words of a state of at least as many.
        self.suffix = [-1] * len(self.length)
        for state in order:
            if self.length[state] >= window:
                above = self.link[state]
                self.suffix[state] = state if self.length[above] < window else self.suffix[above]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in coded:
            state = 0
            for at, word in enumerate(ids):
                state = self.next[state][word]
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if at + 1 >= window:
                    self.items.setdefault(self.suffix[state], set()).add(name)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), name))
        # The nearest state up the links, itself included, at which a short item ends.
        self.above = [-1] * len(self.length)
        for state in order:
            self.above[state] = state if state in self.short else self.above[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        following = self.next[last].get(word)
        if following is not None:
            if self.length[following] == self.length[last] + 1:
                return following
            return self._clone(last, word, following)
        state = self._state({}, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            following = self.next[last][word]
            exact = self.length[following] == self.length[last] + 1
            self.link[state] = following if exact else self._clone(last, word, following)
        return state

    def _clone(self, last: int, word: int, following: int) -> int:
        copy = self._state(dict(self.next[following]), self.length[last] + 1)
        self.link[copy], self.link[following] = self.link[following], copy
        while last >= 0 and self.next[last].get(word) == following:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Runs [first, end) of hit words, in order and apart, and the items found."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        if self.shortest > 1:
            known = known[:-1] & known[1:]
            where = np.flatnonzero(known)
            known[where] = self.pairs[_pair_slot(ids[where], ids[where + 1])]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
        extra = self.shortest > 1
        hits: list[list[int]] = []
        states: set[int] = set()
        names: set[str] = set()
        for first, end in zip(edges[::2].tolist(), (edges[1::2] + extra).tolist()):
            if end - first >= self.shortest:
                self._walk(ids[first:end].tolist(), first, hits, states, names)
        return hits, names.union(*(self.items[state] for state in states))

    def _walk(self, ids, at, hits, states, names) -> None:
        state = matched = 0
        for word in ids:
            at += 1
            following = self.next[state].get(word)
            if following is None:
                while state >= 0 and word not in self.next[state]:
                    state = self.link[state]
                if state < 0:
                    state = matched = 0
                    continue
                matched = self.length[state]
                following = self.next[state][word]
            state, matched = following, matched + 1
            reach = 0
            if matched >= self.window:
                states.add(self.suffix[state])
                reach = self.window
            above = self.above[state]
            while above >= 0:
                for size, name in self.short[above]:
                    if size <= matched:
                        names.add(name)
                        reach = max(reach, size)
                above = self.above[self.link[above]]
            if reach:
                first = at - reach
                while hits and hits[-1][1] >= first:
                    first = min(first, hits.pop()[0])
                hits.append([first, at])


def union(runs: list[list[int]]) -> list[list[int]]:
    """The same words as runs that are in order and apart."""
    out: list[list[int]] = []
    for first, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


class _Items:
    """Arrow batches of (item, text) to pieces (item, words); pieces of an item overlap by a window less one."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text.encode())
                for first in range(0, max(1, len(words) - self.window + 1), PIECE_WORDS):
                    part = words[first:first + PIECE_WORDS + self.window - 1]
                    if part:
                        out.append((name, b" ".join(part).decode(), len(part)))
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "words", "n"])


def automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text",
             block_words: int = BLOCK_WORDS) -> Iterator:
    """Broadcast automata, one for each block of the items; each is built from one collected block."""
    spark = items.sparkSession
    ship_package(spark)
    cut = stage(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                .mapInArrow(_Items(window), "item string, words string, n long").distinct(), "items")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        rows = cut.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).select("item", "words").collect()
        # Equal sequences are inserted once each; the automaton does not grow by a repeated one.
        yield spark.sparkContext.broadcast(Automaton([(r.item, r.words.encode().split(b" ")) for r in rows], window))


class _Mark:
    """Adds or widens the columns n_words, hits and items of Arrow batches."""

    def __init__(self, automaton, text: int, first: bool):
        self.automaton, self.text, self.first = automaton, text, first

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = self.automaton.value
        for batch in pieces(batches):
            counts, hits, names = [], [], []
            for text in batch.column(self.text).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                runs, found = automaton.scan(words) if len(words) >= automaton.shortest else ([], set())
                counts.append(len(words))
                hits.append(runs)
                names.append(found)
            columns = batch.columns
            if not self.first:
                hits = [union(old + new) for old, new in zip(columns[-2].to_pylist(), hits)]
                names = [new.union(old) for old, new in zip(columns[-1].to_pylist(), names)]
                columns = columns[:-3]
            columns = [*columns, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32()))),
                       pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


def mark(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
         block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """`docs` with three more columns, whose names are returned: words, runs of hit words, ids of items found.

    The runs are [first, end) by word. Between two blocks of the benchmark the rows are staged.
    """
    names = fresh(docs, "n_words", "hits", "items")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], HITS), T.StructField(names[2], T.ArrayType(T.StringType()))])
    marked = docs
    for i, automaton in enumerate(automata(items, window, block_words=block_words)):
        if i:
            marked = stage(marked, "marked")
        marked = marked.mapInArrow(_Mark(automaton, docs.columns.index(text_col), not i), schema)
    return marked, names


class _Cut:
    """Removes the runs of hit words from the texts of Arrow batches."""

    def __init__(self, text: int, hits: int):
        self.text, self.hits = text, hits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(self.text).to_pylist()
            for i, runs in enumerate(batch.column(self.hits).to_pylist()):
                if runs:
                    places = [m.span() for m in _WORD.finditer(texts[i].translate(_LOWER))]
                    kept, at = [], 0
                    for first, end in runs:
                        kept.append(texts[i][at:places[first][0]])
                        at = places[end - 1][1]
                    texts[i] = "".join([*kept, texts[i][at:]])
            columns = list(batch.columns)
            columns[self.text] = pa.array(texts, batch.schema.field(self.text).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
          max_coverage: float = 0.5) -> DataFrame:
    """`docs` without benchmark text, same columns.

    Documents of which more than `max_coverage` of the words are hit go. From the others every hit run is
    removed, with what stands between its words. A document without a hit stays as it is.
    """
    marked, (n_words, hits, found) = mark(docs, items, window, text_col)
    n_hit = F.aggregate(hits, F.lit(0), lambda total, run: total + run[1] - run[0])
    kept = marked.filter(n_hit <= F.col(n_words) * max_coverage)
    cut = kept.mapInArrow(_Cut(docs.columns.index(text_col), marked.columns.index(hits)), marked.schema)
    return cut.select(*docs.columns)


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: words, hit words, items found and their digest."""
    marked, _ = mark(docs.select("doc_id", "text"), items, window)
    return marked.select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda total, run: total + (run[1] - run[0]).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))

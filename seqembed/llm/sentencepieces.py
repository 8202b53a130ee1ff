"""SentencePiece BPE with byte fallback: a table of distinct chunks, each segmented once, joined back by position.

No piece of the model goes on past a character into a whitespace marker, so a marked word (markers and what
follows them) is segmented alike wherever it stands. The same holds on both sides of an ASCII character that is
part of no longer piece. A worker cuts texts into such chunks, numbers the distinct ones in a table, segments
those that are new, and joins ids back to the texts by the positions of their chunks in one gather. A model
whose pieces do go on into a marker is handled too: then a whole text is one chunk.

A chunk is merged by score, best first and leftmost among equals. New chunks lie end to end in one array and are
merged in rounds, each chunk its best pair. Chunks of more than `SHORT` characters, with characters outside the
vocabulary or with pieces that share a score are merged one by one with a heap, so that one very long word of n
characters costs n log n. Both give the same ids. Characters outside the vocabulary become the bytes of their UTF-8.

A worker process keeps its table from task to task. Beyond `TABLE_CHUNKS` chunks or `TABLE_CHARS` characters the
chunks that were met least go, and a long text is taken in runs of `RUN` chunks, so a worker holds its batch, one
table and one run; results do not depend on these bounds. Missing and empty texts give no ids and decode to the empty text. Repeated rows are encoded each on
its own row. Other columns pass through, and helper columns get names that no column has.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bpe import NONE, Vocabulary, spans
from .common import fresh, pieces, sha256_hex, ship_package

MARK = "▁"
SHORT = 64
TABLE_CHUNKS = 250_000
TABLE_CHARS = 8_000_000
RUN = 1 << 18
LONG_TEXT = 1 << 20
UNKNOWN, CONTROL, BYTE = 2, 3, 6  # fixed values: the types of pieces in a model file


class _Pairs(Vocabulary):
    """The hash table of a vocabulary alone: (left, right) to the merged symbol, whose number is its rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._hash(keys, values)


class PieceModel:
    """Ranks, ids and bytes of the pieces of a model file; a few MB, built once on the driver."""

    table: ChunkTable | None = None

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces} - {1, UNKNOWN, CONTROL, BYTE}
        if (trained.model_type != trained.BPE or not trained.byte_fallback or kinds or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or trained.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with byte fallback, a leading marker and no normalisation are supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        order = {score: n for n, score in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        self.ids = normal
        self.rank = {piece: order[proto.pieces[i].score] for piece, i in normal.items()}
        # For rounds over many chunks a piece is numbered by its rank; pieces that share a score have no order of their own.
        ranked = sorted(normal, key=lambda piece: (self.rank[piece], normal[piece]))
        number = {piece: n for n, piece in enumerate(ranked)}
        self.final = np.array([normal[piece] for piece in ranked], np.int32)
        self.codes = np.full(0x110000, -1, np.int32)
        for piece in ranked:
            if len(piece) == 1:
                self.codes[ord(piece)] = number[piece]
        pairs = {number[p[:i]] << 32 | number[p[i:]]: number[p]
                 for p in ranked for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.pairs = _Pairs(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        shared = Counter(self.rank[piece] for piece in normal if len(piece) > 1)
        tied = [piece for piece in ranked if len(piece) > 1 and shared[self.rank[piece]] > 1]
        self.tied = re.compile("|".join(map(re.escape, tied)) or r"(?!)")
        self.longest = max(map(len, normal))
        self.byte_ids = [0] * 256
        data = []
        self.kinds = np.array([p.type for p in proto.pieces], np.int8)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                data.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == CONTROL:
                data.append(b"")
            elif p.type == UNKNOWN:
                data.append((trained.unk_surface or " ⁇ ").encode())
            else:
                data.append(p.piece.replace(MARK, " ").encode())
        self.lengths = np.fromiter(map(len, data), np.int64, len(data))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.spaced = (self.kinds == 1) & (self.bytes[np.minimum(self.starts, len(self.bytes) - 1)] == 32)
        if any(MARK in piece.lstrip(MARK) for piece in normal):
            self.pattern = r"(?s).+"
        else:
            inner = set("".join(piece for piece in normal if len(piece) > 1))
            solo = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner)
            self.pattern = f"{MARK}*[^{MARK}{solo}]+|{MARK}+|[{solo}]" if solo else f"{MARK}*[^{MARK}]+|{MARK}+"

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk, merged with a heap."""
        rank, size, longest = self.rank, len(chunk), self.longest
        end = list(range(1, size + 1))  # where the symbol that starts here ends; 0 once it is swallowed
        before = list(range(-1, size - 1))
        heap = [(rank[pair], i, i + 2) for i in range(size - 1) if (pair := chunk[i:i + 2]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= size or end[middle] != stop:
                continue  # one side has been merged since
            end[i], end[middle] = stop, 0
            first = before[i]
            if first >= 0 and stop - first <= longest and (found := rank.get(chunk[first:stop])) is not None:
                heapq.heappush(heap, (found, first, stop))
            if stop < size:
                before[stop] = i
                last = end[stop]
                if last - i <= longest and (found := rank.get(chunk[i:last])) is not None:
                    heapq.heappush(heap, (found, i, last))
        ids, i = [], 0
        while i < size:
            piece = chunk[i:end[i]]
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            i = end[i]
        return ids

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `chunks`, one after the other, and how many ids each has."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        tied = self.tied.search
        plain = np.flatnonzero(np.fromiter((len(c) <= SHORT and not tied(c) for c in chunks), bool, len(chunks)))
        symbols = self.codes[np.frombuffer("".join([chunks[i] for i in plain]).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(plain, sizes[plain])
        strange = np.zeros(len(chunks), bool)
        strange[owner[symbols < 0]] = True  # characters outside the vocabulary
        kept = ~strange[owner]
        owner, symbols = self._rounds(owner[kept], symbols[kept])
        slow = np.ones(len(chunks), bool)
        slow[plain] = strange[plain]
        counts = np.bincount(owner, minlength=len(chunks))
        rest = {int(i): self.segment(chunks[i]) for i in np.flatnonzero(slow)}
        counts[list(rest)] = [len(ids) for ids in rest.values()]
        ids = np.empty(int(counts.sum()), np.int32)
        ids[np.repeat(~slow, counts)] = self.final[symbols]
        ids[np.repeat(slow, counts)] = np.fromiter(chain.from_iterable(rest.values()), np.int32)
        return ids, counts

    def _rounds(self, owner: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and symbols after all merges; every chunk merges its leftmost best pair in each round."""
        done = [(owner[:0], symbols[:0])]
        ranks = np.full(len(symbols), NONE, np.int32)  # of each symbol and the next one of its chunk
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self.pairs.rank(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            new = np.append(True, owner[1:] != owner[:-1])
            starts, chunk = np.flatnonzero(new), np.cumsum(new) - 1
            best = np.minimum.reduceat(ranks, starts)[chunk]
            alive = best < NONE
            if not alive.all():
                done.append((owner[~alive], symbols[~alive]))
                owner, symbols, ranks, best, chunk = (x[alive] for x in (owner, symbols, ranks, best, chunk))
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == best)
            at = at[np.append(True, chunk[at[1:]] != chunk[at[:-1]])]
            symbols[at] = best[at]
            rest = np.ones(len(symbols), bool)
            rest[at + 1] = False
            owner, symbols, ranks = owner[rest], symbols[rest], ranks[rest]
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                paired = (right > left) & (owner[right] == owner[left])
                ranks[left] = np.where(paired, self.pairs.rank(symbols[left], symbols[right]), NONE)
        owner, symbols = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(owner, kind="stable")
        return owner[order], symbols[order]

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of lists of ids; list i ends at ends[i + 1]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the model")
        lengths = self.lengths[ids]
        data = self.bytes[spans(self.starts[ids], lengths)].tobytes()
        total = np.concatenate([[0], np.cumsum(lengths)])
        cut = total[ends]
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        heads = np.searchsorted(shown, ends[:-1])  # the first id of each list that is not a control
        texts = []
        for i in range(len(ends) - 1):
            head = shown[heads[i]] if heads[i] < len(shown) else len(ids)
            skip = head < ends[i + 1] and self.spaced[ids[head]]
            # Bytes form no character across a control piece.
            stops = [*(ends[i] + np.flatnonzero(self.kinds[ids[ends[i]:ends[i + 1]]] == CONTROL)), ends[i + 1]]
            at, text = cut[i] + (1 if skip else 0), []
            for stop in stops:
                text.append(_text(data[at:total[stop]]))
                at = max(at, total[stop])
            texts.append("".join(text))
        return texts


def _text(data: bytes) -> str:
    """Text of bytes, with U+FFFD for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(data[at:at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


class ChunkTable:
    """Distinct chunks with their ids; texts are looked up by the positions of their chunks."""

    def __init__(self, pattern, merge: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.pattern, self.merge = pattern, merge
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat = np.empty(0, np.int32)
        self.starts = self.counts = self.met = np.empty(0, np.int64)

    def _thin(self) -> None:
        """Keep the most frequent chunks, half of the table at most."""
        order = np.argsort(-self.met, kind="stable")[:TABLE_CHUNKS // 2]
        names = list(self.known)
        chars = np.cumsum([len(names[i]) for i in order.tolist()])
        kept = order[(self.met[order] > 1) & (chars <= TABLE_CHARS // 2)]
        flat, starts, counts, met = self.flat, self.starts[kept], self.counts[kept], self.met[kept]
        self._clear()
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.known))
        self.flat, self.counts, self.met = flat[spans(starts, counts)], counts, met // 2
        self.starts = np.cumsum(counts) - counts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many ids each text has."""
        out, sizes, held = [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if len(text) <= LONG_TEXT:
                held.append((i, self.pattern.findall(text)))
                continue
            matches = (match.group() for match in self.pattern.finditer(text))
            self._take(held, out, sizes)
            held = []
            while run := list(islice(matches, RUN)):
                self._take([(i, run)], out, sizes)
        self._take(held, out, sizes)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), sizes

    def _take(self, held: list[tuple[int, list[str]]], out: list[np.ndarray], sizes: np.ndarray) -> None:
        if not held:
            return
        if len(self.known) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self._thin()
        known = self.known
        new = list(set().union(*(chunks for _, chunks in held)).difference(known))
        ids, counts = self.merge(new)
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.chars += sum(map(len, new))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, ids])
        each = np.fromiter((len(chunks) for _, chunks in held), np.int64, len(held))
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(chunks for _, chunks in held)), np.int64, int(each.sum()))
        self.met = np.append(self.met, np.zeros(len(new), np.int64)) + np.bincount(index, minlength=len(known))
        lengths = self.counts[index]
        out.append(self.flat[spans(self.starts[index], lengths)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(each)
        np.add.at(sizes, [i for i, _ in held], total[ends] - total[ends - each])


def piece_table(model: PieceModel) -> ChunkTable:
    """The table of a model, kept with it from task to task of a worker process."""
    if model.table is None:
        model.table = ChunkTable(re.compile(model.pattern), model.merge)
    return model.table


class _Encode:
    """Puts the ids, as the last column, in place of the text in Arrow batches."""

    def __init__(self, model, text: int):
        self.model, self.text = model, text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        table = piece_table(model)
        for batch in pieces(batches):
            ids, sizes = table([model.marked(text or "") for text in batch.column(self.text).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            columns = [*batch.columns[:self.text], *batch.columns[self.text + 1:], lists]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


class _Decode:
    """Arrow batches of (..., ids) with the decoded text as one more column."""

    def __init__(self, model, column: int):
        self.model, self.column = model, column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in pieces(batches):
            lists = batch.column(self.column).fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            texts = pa.array(model.decode(ids, offsets - offsets[0]), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[str(i) for i in range(batch.num_columns + 1)])


def shared(spark: SparkSession, path: str):
    """The model at `path` as a broadcast variable; its size is that of the file, not of the data."""
    ship_package(spark)
    return spark.sparkContext.broadcast(PieceModel(path))


def encode(docs: DataFrame, model, text_col: str = "text") -> tuple[DataFrame, str]:
    """`docs` with the ids in place of the text, and the name of that last column; `model` comes from `shared`."""
    (name,) = fresh(docs, "ids")
    at = docs.columns.index(text_col)
    rest = [field for i, field in enumerate(docs.schema.fields) if i != at]
    schema = T.StructType([*rest, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_Encode(model, at), schema), name


def decode(encoded: DataFrame, model, ids_col: str = "ids") -> tuple[DataFrame, str]:
    """`encoded` with the text of the ids in a last column, whose name is returned.

    Missing ids count as none; ids that are not in the model raise. Bytes that form no character become U+FFFD.
    """
    (name,) = fresh(encoded, "decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    return encoded.mapInArrow(_Decode(model, encoded.columns.index(ids_col)), schema), name


def report(docs: DataFrame, model) -> DataFrame:
    """Counts and digests of every row of `docs`, encoded and decoded."""
    encoded, ids = encode(docs.select("doc_id", "text"), model)
    decoded, text = decode(encoded, model, ids)
    return decoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col(ids).cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_hex(F.encode(F.col(text), "UTF-8")).alias("decoded_sha256"))

"""Secret scans: fixed patterns, and password guess cost for values in a credential context.

Base spans are the leftmost, non-overlapping matches of three patterns, of which those that are too short
are dropped. Added spans are values next to a credential word that would take many guesses: the cheapest
way to segment the value into dictionary words, dates, repeats, keyboard walks, sequences and characters
that have to be tried one by one, found by dynamic programming over its ends. Costs are log10 of guesses.
An added span is the value alone and may lie in a base span, which stays. Offsets are code points, ends exclusive.

Missing and empty texts have no spans. Repeated rows are scanned each on its own. The program is linear
in the length of a value, so very long values are scanned whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import fresh, pieces, sha256_hex, ship_package

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 8.0
MIN_GUESSES_LETTERS = 16.0  # of a value of letters alone, which prose has too
MIN_VALUE = 6
MARK = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|code|phrase)?|pwd|secret|token|api[_ -]?key|credentials?|login|auth)["']?"""
    r"""(?:\x20{0,4}(?::=|=>|->|[:=])\x20{0,4}|\x20is\x20)["'`]?([^\s"'`]+)""", re.ASCII | re.IGNORECASE)
_CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"api", b"credential", b"login", b"auth")
_HEX_RUN = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("guesses", T.DoubleType())]))

COMMON = """password 123456 12345678 qwerty letmein admin welcome monkey dragon master iloveyou sunshine princess
    football shadow superman trustno1 baseball hunter changeme default secret root login test guest""".split()
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("013457@$!", "oieastasi")
LONGEST_WORD = 20
LONGEST_RUN = 64
_DATE = re.compile(r"(?:19|20)\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:\d\d|(?:19|20)\d\d)?"
                   r"|(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
                   r"|\d{1,2}[-/.]\d{1,2}[-/.](?:\d\d|\d{4})|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}")
_DATE_COST = {4: math.log10(366), 6: math.log10(366 * 100), 8: math.log10(366 * 120), 10: math.log10(366 * 120 * 4)}


def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """For each key its neighbours with the direction to them; a lower row lies half a key to the right."""
    at = {key: (row, column) for row, keys in enumerate(_ROWS) for column, key in enumerate(keys)}
    steps = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
    return {a: {b: (y - v, x - w) for b, (y, x) in at.items() if (y - v, x - w) in steps} for a, (v, w) in at.items()}


NEXT_KEY = _neighbours()


class Guesser:
    """Guess costs with a ranked word list."""

    def __init__(self, words: dict[str, int]):
        self.words = dict(words)
        for i, word in enumerate(COMMON):
            self.words[word] = i + 1

    def cost(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation of `value` takes.

        Segments that join add 0.3, but for characters that are tried one after the other. Runs of equal keys,
        walks, sequences and repeats are segments from wherever their run began, or of at most `LONGEST_RUN`.
        """
        low = value.lower() if len(value.lower()) == len(value) else value
        plain = low.translate(_LEET)
        size = len(value)
        tried, known = [math.inf] * (size + 1), [math.inf] * (size + 1)  # by what the last segment is
        known[0] = 0.0
        best = [0.0] * (size + 1)
        same = walk = rise = 0  # where the run of equal keys, the walk, the sequence began
        turned, heading, slope = [0] * (size + 1), None, 0  # turns of the walk up to each key
        lag = [0] * 9
        for end in range(1, size + 1):
            last = end - 1
            one = value[last]
            alphabet = 10 if one.isdigit() else 26 if one.isalpha() else 33
            tried[end] = min(tried[last], known[last] + (0.3 if last else 0)) + math.log10(alphabet)
            ways = []
            for begin in range(max(0, end - LONGEST_WORD), end - 2):
                rank = self.words.get(low[begin:end])
                if rank:
                    ways.append((begin, math.log10(rank + 1) + (0.3 if low[begin:end] != value[begin:end] else 0)))
                elif plain[begin:end] != low[begin:end] and (rank := self.words.get(plain[begin:end])):
                    ways.append((begin, math.log10(rank + 1) + 0.6))
            if one.isdigit():
                for length in (4, 6, 8, 10):
                    if length <= end and _DATE.fullmatch(low, end - length, end):
                        ways.append((end - length, _DATE_COST[length]))
            if last:
                before = low[last - 1]
                if low[last] != before:
                    same = last
                step = NEXT_KEY.get(before, {}).get(low[last])
                if step is None:
                    walk = last
                turned[last] = turned[last - 1] + (step is not None and step != heading)
                heading = step
                delta = ord(low[last]) - ord(before)
                if delta not in (1, -1) or not low[last].isalnum():
                    rise, slope = last, 0
                elif delta != slope:
                    rise, slope = last - 1, delta
            for begin in _begins(same, end, 3):
                ways.append((begin, math.log10(alphabet * (end - begin))))
            for begin in _begins(walk, end, 4):  # the first step of a walk is a turn
                turns = turned[last] - turned[begin + 1] + 1
                ways.append((begin, math.log10(47 * (end - begin)) + turns * math.log10(4.6)))
            for begin in _begins(rise, end, 3):
                ways.append((begin, math.log10(10 * (end - begin))))
            for period in range(2, 9):
                lag[period] = lag[period] + 1 if last >= period and low[last] == low[last - period] else 0
                for begin in _begins(end - lag[period] - period, end, 2 * period) if lag[period] >= period else ():
                    block = best[begin + period] - best[begin]
                    ways.append((begin, max(block, 1.0) + math.log10((end - begin) / period)))
            known[end] = min((best[begin] + way + (0.3 if begin else 0) for begin, way in ways), default=math.inf)
            best[end] = min(tried[end], known[end])
        return best[size]


def _begins(first: int, end: int, least: int) -> Iterator[int]:
    """Where segments of a run that began at `first` may begin: there, or `LONGEST_RUN` before the end or later."""
    if first + least <= end:
        yield first
        yield from range(max(first + 1, end - LONGEST_RUN), end - least + 1)


class Scanner:
    """Spans of one text."""

    def __init__(self, words: dict[str, int], min_guesses: float):
        self.guesser, self.min_guesses = Guesser(words), min_guesses

    def scan(self, text: str, data: bytes) -> list[tuple[int, int, int, float | None]]:
        """(start, kind, end, guesses) by start, then kind; `data` is the text in UTF-8."""
        low = data.lower()
        spans = []
        if any(word in low for word in _ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if b"AKIA" in data:
            spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        if b"h" * 16 in data.translate(_HEX_RUN):
            spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
        if any(word in low for word in _CONTEXT_WORDS):
            spans += [(a, 3, b, cost) for a, b, cost in self._values(text)]
        return sorted(spans, key=lambda span: span[:3])

    def _values(self, text: str) -> Iterator[tuple[int, int, float]]:
        for match in CONTEXT.finditer(text):
            value = match[1].rstrip(".,;:!?)]}>")
            if len(value) < MIN_VALUE or "://" in value:
                continue
            if value.isalpha() and (value[1:].islower() or value.isupper() or value.islower()):
                floor = max(MIN_GUESSES_LETTERS, self.min_guesses)
            else:
                floor = self.min_guesses
            cost = self.guesser.cost(value)
            if cost >= floor:
                yield match.start(1), match.start(1) + len(value), cost


class _Scan:
    """Arrow batches with the spans appended; with `drop`, in place of the text."""

    def __init__(self, words, min_guesses: float, text: int, drop: bool):
        self.words, self.min_guesses, self.text, self.drop = words, min_guesses, text, drop

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(self.words.value, self.min_guesses)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64())]))
        for batch in pieces(batches):
            column = batch.column(self.text)
            spans = [[(KINDS[k], a, b, g) for a, k, b, g in scanner.scan(text or "", data or b"")]
                     for text, data in zip(column.to_pylist(), column.cast(pa.binary()).to_pylist())]
            spans = pa.array([[dict(zip(("kind", "start", "end", "guesses"), s)) for s in row] for row in spans], kind)
            columns = [c for i, c in enumerate(batch.columns) if not (self.drop and i == self.text)]
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[str(i) for i in range(len(columns) + 1)])


class _Redact:
    """Arrow batches with the spans, the last column, put out of sight in the text."""

    def __init__(self, text: int):
        self.text = text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(self.text).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[i] = redacted(texts[i], [(s["start"], s["end"]) for s in spans])
            columns = list(batch.columns)
            columns[self.text] = pa.array(texts, batch.schema.field(self.text).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with a mark for each run of overlapping spans."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def word_ranks(path: str) -> dict[str, int]:
    """Lower-case words of a rank file, by rank: tokens of a space and three letters or more."""
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(a) for a, _ in map(bytes.split, lines)]
    words = (token[1:].decode() for token in tokens if re.fullmatch(rb" [a-z]{3,}", token))
    return {word: rank for rank, word in enumerate(words, 1)}


def shared(spark: SparkSession, path: str):
    """The word list as a broadcast variable; its size is that of the vocabulary file."""
    ship_package(spark)
    return spark.sparkContext.broadcast(word_ranks(path))


def scan(docs: DataFrame, words, text_col: str = "text", min_guesses: float = MIN_GUESSES,
         drop: bool = False) -> tuple[DataFrame, str]:
    """`docs` with the spans of each text in a last column, whose name is returned; `words` comes from `shared`."""
    (name,) = fresh(docs, "spans")
    at = docs.columns.index(text_col)
    fields = [field for i, field in enumerate(docs.schema.fields) if not (drop and i == at)]
    return docs.mapInArrow(_Scan(words, min_guesses, at, drop), T.StructType([*fields, T.StructField(name, SPANS)])), name


def redact(docs: DataFrame, words, text_col: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """`docs` with every secret replaced by a mark, same columns and rows."""
    scanned, _ = scan(docs, words, text_col, min_guesses)
    return scanned.mapInArrow(_Redact(docs.columns.index(text_col)), scanned.schema).select(*docs.columns)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, words) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans, for every row of `docs`."""
    found, name = scan(docs.select("doc_id", "text"), words, drop=True)
    base = F.filter(name, lambda s: s["kind"] != "guess")
    counts = [F.size(F.filter(F.col(f"{name}.kind"), F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:3], sha256_hex(written(base)).alias("base_sha256"),
                        written(F.col(name)).alias("spans"), counts[3])

"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order. A keyed permutation of 0 to n - 1 gives each row a place; the place modulo
the number of shards is its shard, the place divided by it its slot. So the shuffle is reproducible, shards are
at most one row apart, slots have no gap, and the shard and slot of a row number, and the row number of a shard
and slot, can be computed without a table.

The permutation: a place is a pair (left, right) with left below a and right below b, where a * b is n or barely
more. In each round a keyed function of one half is added to the other, modulo its size. A place of n or more is
permuted again, until it falls below n (cycle walking). There are fewer than a such places, about the root of n,
so the longest walk among them is computed beforehand and the expression is unrolled just as often.

Rows with equal keys of the order are equal in all columns that are ordered by; they share their places in any
order. Missing ids come first. Empty tables give no rows. All of it is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rank import row_numbers
from .common import fresh, stage

PRIME = (1 << 31) - 1
ROUNDS = 6
# Multiplier and increment of each round; any numbers below PRIME do, the seed is added.
_KEYS = [(1103515245 + 7919 * r, 12345 + 104729 * r) for r in range(ROUNDS)]


class Permutation:
    """A permutation of 0 to n - 1, on integers and on columns; n is at most PRIME squared."""

    def __init__(self, n: int, seed: int = 0):
        self.n = max(1, n)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        self.keys = [((m + seed) % PRIME, (c + 31 * seed) % PRIME) for m, c in _KEYS]
        self.walks = 0  # further steps that bring every place below n
        for first in range(self.n, self.a * self.b):
            place, steps = self._step(first), 1
            while place >= self.n and place != first:
                place, steps = self._step(place), steps + 1
            if place != first:  # a cycle of such places alone is never entered
                self.walks = max(self.walks, steps)

    def _function(self, x, key):
        """A keyed function of half a place; all products stay below 2^62."""
        multiplier, increment = key
        x = (x + increment) % PRIME
        x = (x * x + multiplier) % PRIME
        return (x * multiplier + increment) % PRIME

    def _step(self, place: int) -> int:
        left, right = place % self.a, place // self.a
        for r, key in enumerate(self.keys):
            if r % 2:
                right = (right + self._function(left, key)) % self.b
            else:
                left = (left + self._function(right, key)) % self.a
        return right * self.a + left

    def _back(self, place: int) -> int:
        left, right = place % self.a, place // self.a
        for r, key in reversed(list(enumerate(self.keys))):
            if r % 2:
                right = (right - self._function(left, key)) % self.b
            else:
                left = (left - self._function(right, key)) % self.a
        return right * self.a + left

    def place(self, row: int) -> int:
        """Where a row number goes."""
        row = self._step(row)
        while row >= self.n:
            row = self._step(row)
        return row

    def row(self, place: int) -> int:
        """Which row number comes to a place."""
        place = self._back(place)
        while place >= self.n:
            place = self._back(place)
        return place

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """`df` with the row numbers in `column` replaced by their places."""
        left, right = fresh(df, "left", "right")
        for walk in range(1 + self.walks):
            # One projection per half and round, so no expression is written out twice.
            again = F.lit(True) if not walk else F.col(column) >= self.n
            df = df.withColumns({left: F.col(column) % self.a, right: F.expr(f"`{column}` div {self.a}")})
            for r, key in enumerate(self.keys):
                if r % 2:
                    df = df.withColumn(right, (F.col(right) + self._function(F.col(left), key)) % self.b)
                else:
                    df = df.withColumn(left, (F.col(left) + self._function(F.col(right), key)) % self.a)
            df = df.withColumn(column, F.when(again, F.col(right) * self.a + F.col(left)).otherwise(F.col(column)))
        return df.drop(left, right)


def locate(permutation: Permutation, row: int, shards: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = permutation.place(row)
    return place % shards, place // shards


def row_at(permutation: Permutation, shard: int, slot: int, shards: int) -> int:
    """The row number in a slot of a shard."""
    return permutation.row(slot * shards + shard)


def assign(docs: DataFrame, order: list[str], shards: int = 40, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """`docs` with its row number, shard and slot in three last columns, whose names are returned.

    Rows are numbered from 0 by `order`. `docs` is read twice and is best a scan or a staged table.
    """
    row, shard, slot, place = fresh(docs, "row", "shard", "slot", "place")
    numbered = row_numbers(docs, order, name=row).withColumn(row, F.col(row) - 1)
    permutation = Permutation(docs.count(), seed)
    placed = permutation.apply(numbered.withColumn(place, F.col(row)), place)
    return placed.select(*docs.columns, row, (F.col(place) % shards).cast("int").alias(shard),
                         F.expr(f"`{place}` div {shards}").alias(slot)), [row, shard, slot]


def write(docs: DataFrame, path: str, order: list[str], shards: int = 40, seed: int = 0) -> None:
    """Write `docs` as one folder per shard, with rows in the order of their slots within each file."""
    assigned, (_, shard, slot) = assign(docs, order, shards, seed)
    assigned.repartition(shard, F.expr(f"`{slot}` div 100000")).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def report(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Size, checksum, shard and slot of every row of `docs`, numbered by id, checksum and size."""
    narrow = stage(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                               crc("text").alias("text_crc32")), "sizes")
    assigned, (_, shard, slot) = assign(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return assigned.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col(shard).alias("shard"),
                           F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _sql_function(x: str, key: tuple[int, int]) -> str:
    """The keyed function in SQL; the inner square names its argument twice, by a list of one."""
    multiplier, increment = key
    return (f"((list_transform([({x} + {increment}) % {PRIME}], lambda v: v * v + {multiplier})[1] % {PRIME}) "
            f"* {multiplier} + {increment}) % {PRIME}")


def report_sql(shards: int = 40, seed: int = 0) -> str:
    """`report` over the view `documents` in DuckDB; six walks are enough for its sizes."""
    keys = Permutation(1, seed).keys
    steps, source = [], "rows0"
    for walk in range(6):
        steps.append(f"h{walk} AS (SELECT *, place % a AS l0, place // a AS r0 FROM {source})")
        before = f"h{walk}"
        for i, key in enumerate(keys):
            half, other, size = ("r0", "l0", "b") if i % 2 else ("l0", "r0", "a")
            steps.append(f"s{walk}_{i} AS (SELECT * EXCLUDE ({half}), "
                         f"({half} + {_sql_function(other, key)}) % {size} AS {half} FROM {before})")
            before = f"s{walk}_{i}"
        again = "true" if not walk else "place >= n"
        steps.append(f"w{walk} AS (SELECT * EXCLUDE (place, l0, r0), "
                     f"CASE WHEN {again} THEN r0 * a + l0 ELSE place END AS place FROM {before})")
        source = f"w{walk}"
    return f"""WITH RECURSIVE crc_step(k, i, c) AS (
    SELECT range AS k, 0 AS i, range AS c FROM range(256)
    UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_step WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY k) AS t FROM crc_step WHERE i = 8),
sized AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
           xor(list_reduce(list_concat([4294967295], list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
               lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32
    FROM documents, crc_table),
counted AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM sized),
halves AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM counted),
rows0 AS (SELECT *, (n + a - 1) // a AS b FROM halves),
{','.join(chr(10) + step for step in steps)}
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {shards} AS INTEGER) AS shard, place // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM {source}"""

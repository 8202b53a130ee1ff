"""Exact row numbers and top-k, without handing one key or the whole table to one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import ship_package, stage

# A key of up to this many rows is sorted by one task.
WINDOW_ROWS = 2_000_000
MAX_SALTS = 4096
_WITHIN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def row_numbers(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (),
                name: str = "row_number", size: str | None = None, window_rows: int | None = None) -> DataFrame:
    """Number the rows of each key 1, 2, ... in `order`; with no keys, number the whole table.

    Ties are numbered in any order. `size` names a further column with the rows of the key. A key of more than
    `window_rows` rows (`WINDOW_ROWS` when left out) is not left to one task.

    Keys are counted first, so `df` is best a scan or a staged table. While the largest key is
    small, a window does. Otherwise, and for a whole table, rows are range-partitioned on (keys,
    order), so a hot key is cut into as many pieces as its size asks for, and so are ties. Each
    partition counts its own rows, and the counts of the earlier partitions are added on. The
    numbered partitions are staged, as counts and rows have to come from the same split.
    """
    columns = df.columns
    if keys and largest_group(df, keys) <= (WINDOW_ROWS if window_rows is None else window_rows):
        whole = Window.partitionBy(*keys)
        numbered = df.select("*", F.row_number().over(whole.orderBy(*order)).cast("long").alias(name))
        return numbered.withColumn(size, F.count("*").over(whole)) if size else numbered

    ordering = [*keys, *order, "_tie"]
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(*ordering).sortWithinPartitions(*ordering).drop("_tie")
              .withColumn("_part", F.spark_partition_id()))
    if keys:
        ship_package(df.sparkSession)
        schema = T.StructType([*ranged.schema.fields, T.StructField("_pos", T.LongType())])
        numbered = ranged.mapInArrow(_RunCounter(tuple(keys)), schema)
    else:
        position = F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN_PARTITION)) + 1
        numbered = ranged.withColumn("_pos", position)
    staged = stage(numbered, "row-numbers")

    counts = staged.groupBy(*keys, "_part").agg(F.max("_pos").alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition at most: only the first key of a partition can begin in an earlier one.
    offsets = (counts.select(*[F.col(key).alias(f"_first_{key}") for key in keys], "_part",
                             F.sum("_count").over(earlier).alias("_before"))
               .filter(F.col("_before") > 0))
    joined = staged.join(F.broadcast(offsets), "_part", "left")
    continued = F.lit(True)
    for key in keys:
        continued &= F.col(key).eqNullSafe(F.col(f"_first_{key}"))
    before = F.when(continued, F.coalesce("_before", F.lit(0))).otherwise(0)
    numbered = joined.select(*columns, (F.col("_pos") + before).alias(name))
    if size is None:
        return numbered
    if not keys:
        return numbered.withColumn(size, counts.agg(F.sum("_count")).scalar())
    totals = counts.groupBy(*[F.col(key).alias(f"_of_{key}") for key in keys]).agg(
        F.sum("_count").alias(size))
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return numbered.join(totals, same).select(*columns, name, size)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Number wide rows 1, 2, ... by the columns of `order`; ties are numbered in any order.

    The rows are staged with a handle. Only handles and the columns of `order` are sorted; the rows get their
    numbers in a join, and that is the one time that they move.
    """
    staged = stage(df.withColumn("_handle", F.monotonically_increasing_id()), "rows")
    numbers = row_numbers(staged.select("_handle", *order), order, name=name).select("_handle", name)
    return staged.join(numbers, "_handle").select(*df.columns, name)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key, 0 for an empty table."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


class _RunCounter:
    """Append to sorted Arrow batches the position of each row within its run of equal keys."""

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(key) for key in self.keys]
            first = tuple(column[0].as_py() for column in columns)
            starts = np.zeros(batch.num_rows, dtype=bool)
            for column in columns:
                starts[1:] |= _differs(column[1:], column[:-1])
            rows = np.arange(batch.num_rows, dtype=np.int64)
            position = rows - np.maximum.accumulate(np.where(starts, rows, 0))
            if first == last:
                head = int(np.argmax(starts)) if starts.any() else batch.num_rows
                position[:head] += seen
            seen = int(position[-1]) + 1
            last = tuple(column[-1].as_py() for column in columns)
            names = [*batch.schema.names, "_pos"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(position + 1)], names=names)


def _differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    one_null = pc.xor(left.is_null(), right.is_null())
    return pc.or_(unequal, one_null).to_numpy(zero_copy_only=False)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                  spread: Sequence[str], name: str = "rank") -> DataFrame:
    """The first `k` rows of each key in `order`, with their rank.

    Up to `spark.sql.optimizer.windowGroupLimitThreshold` (1,000 by default) Spark keeps the first
    `k` of each key in every task before the shuffle, and one window is enough for any skew.

    Above, a key is cut into as many slices as a shuffle has partitions, on the hash of the `spread`
    columns, so even one key that fills the table is spread over all tasks. A row outside the first
    `k` of its slice cannot be among the first `k` of the key, so the second step sees at most
    slices times `k` rows per key.
    """
    columns = df.columns
    conf = df.sparkSession.conf
    if k <= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= k)
    salts = min(int(conf.get("spark.sql.shuffle.partitions")), MAX_SALTS)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    slice_order = Window.partitionBy(*keys, "_salt").orderBy(*order)
    key_order = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn(name, F.row_number().over(slice_order)).filter(F.col(name) <= k)
    return (kept.withColumn(name, F.row_number().over(key_order)).filter(F.col(name) <= k)
            .select(*columns, name))

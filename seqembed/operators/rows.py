"""Row-level operators: limits, truncation, filters and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .rank import number_rows, row_numbers

# A longer limit would gather too much in its last task.
TOP_ROWS = 1_000


def limit_rows(df: DataFrame, n: int, order: Sequence[Column | str], top_rows: int | None = None) -> DataFrame:
    """The first `n` rows in `order`; 0 keeps every row.

    A short limit is a top-k that each task prunes on its own. One above `top_rows` (`TOP_ROWS` when left out) would
    gather all its rows in one task, so it filters on distributed row numbers instead.
    """
    if n <= 0:
        return df
    if n <= (TOP_ROWS if top_rows is None else top_rows):
        return df.orderBy(*order).limit(n)
    return row_numbers(df, order, name="_row").filter(F.col("_row") <= n).drop("_row")


def truncate_seq(df: DataFrame, max_len: int, column: str = "sequence") -> DataFrame:
    """Cut `column` at `max_len` characters."""
    return df.withColumn(column, F.substring(column, 1, max_len))


def drop_empty(df: DataFrame, column: str = "sequence") -> DataFrame:
    return df.filter(F.length(column) > 0)


def drop_values(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Remove the rows whose `column` is listed; rows with a null stay.

    A list becomes a filter that reaches the scan, a DataFrame of values an anti join.
    """
    if isinstance(values, DataFrame):
        return df.join(values.select(column), column, "left_anti")
    if not values:
        return df
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(list(values)))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Repartition a file scan with fewer splits than there are task slots over all slots.

    Meant for costly work on a small input. A scan that fills the slots stays as it is, so what is
    shuffled is less than one split per slot. With `rows` a task also gets about so many at most: narrow rows pack so
    densely that one split can hold many millions of them. They are counted, so `df` is best a scan.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def hash_split(df: DataFrame, n: int, key: str, name: str = "node") -> DataFrame:
    """Assign each row to one of `n` groups of nearly equal size, without a shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def equal_split(df: DataFrame, n: int, order: Sequence[Column | str],
                name: str = "node") -> DataFrame:
    """Assign each row to one of `n` groups whose sizes differ by one row at most."""
    numbered = _numbered(df, order)
    return numbered.select(*df.columns, F.pmod(F.col("_number") - 1, F.lit(n)).cast("int").alias(name))


def batch_ids(df: DataFrame, batch_size: int, order: Sequence[Column | str],
              name: str = "batch_id") -> DataFrame:
    """Assign consecutive rows in `order` to batches of `batch_size`, numbered from 0."""
    numbered = _numbered(df, order)
    return numbered.select(
        *df.columns, F.floor((F.col("_number") - 1) / batch_size).cast("long").alias(name))


def _numbered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Plain columns are sorted without the rest of the rows."""
    if all(isinstance(column, str) for column in order):
        return number_rows(df, order, name="_number")
    return row_numbers(df, order, name="_number")


def shard_plan(df: DataFrame, rows: int) -> DataFrame:
    """Rows per numbered shard of `rows` rows, the last one short: a count decides."""
    total = df.select(F.count(F.lit(1)).alias("total"))
    shards = total.filter("total > 0").select(
        "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / rows))).alias("shard"))
    return shards.select("shard", F.least(F.lit(rows), F.col("total") - F.col("shard") * rows).alias("n_rows"))


def cap_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keep all rows of the first `n` distinct values of `key`."""
    kept = limit_rows(df.select(key).distinct(), n, [key])
    return df.join(kept, key, "left_semi")

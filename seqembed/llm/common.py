"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, ship_package, stage

__all__ = ["read", "scratch_path", "ship_package", "stage", "remainder", "pieces", "fresh", "sha256_hex"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def pieces(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `max_bytes`, so a worker holds little at a time."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has, whatever its case."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sha256_hex(column: Column | str) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)

"""Row positions of files, from counts per file: nothing is sorted and no row moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .lookup import lookup_join


def file_offsets(df: DataFrame) -> DataFrame:
    """`(file, n_rows, before)` of a parquet scan: rows per file, and rows in the files before it in name order.

    Counting reads no column. The cumulated table has one row per file.
    """
    sizes = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))


def file_positions(df: DataFrame, name: str = "_position") -> DataFrame:
    """A parquet scan with the position of each row in file order, from 0."""
    offsets = stage(file_offsets(df).select(F.col("file").alias("_file"), F.col("before").alias("_before")), "offsets")
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    placed = lookup_join(rows, offsets, "_file")
    return placed.select(*df.columns, (F.col("_before") + F.col("_index")).alias(name))

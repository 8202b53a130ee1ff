"""Sequence length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def length_stats(df: DataFrame, column: str = "sequence") -> DataFrame:
    """One row with the count, minimum, upper median and maximum length of `column`.

    The upper median is the element at position n // 2 of the sorted lengths, counted from 0.
    Lengths are counted first, so the ordered step sees one row per distinct length.
    """
    histogram = df.groupBy(F.length(column).alias("length")).agg(F.count("*").alias("n"))
    running = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    ranked = histogram.select(
        "length", F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("total"), "n")
    middle = F.floor(F.col("total") / 2) + 1
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.min("length").alias("min_len"),
        F.min(F.when(F.col("upto") >= middle, F.col("length"))).alias("median_len"),
        F.max("length").alias("max_len"),
    )

"""Checks before and after a job."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def already_done(spark: SparkSession, table: str, min_rows: int = 100) -> bool:
    """Whether `table` exists and has more than `min_rows` rows; reads no more than it must."""
    if not spark.catalog.tableExists(table):
        return False
    return spark.table(table).limit(min_rows + 1).count() > min_rows


def preflight(spark: SparkSession, path: str) -> DataFrame:
    """The parquet folder `path`; raises when it is missing or empty."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no input at {path}") from error
    if df.isEmpty():
        raise ValueError(f"input at {path} is empty")
    return df


def reconcile(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row with the input count, the output count and whether they agree."""
    counted = source.select(F.count(F.lit(1)).alias("input_rows"))
    out_rows = output.select(F.count(F.lit(1))).scalar()
    return counted.withColumn("output_rows", out_rows).withColumn(
        "matches", F.col("input_rows") == F.col("output_rows"))


def postflight(spark: SparkSession, path: str, expected_rows: int, strict: bool = False) -> int:
    """Rows at `path`; raises when there is no output, and warns, or if `strict` raises, when the count differs."""
    try:
        rows = spark.read.parquet(path).count()
    except AnalysisException as error:
        raise FileNotFoundError(f"no output at {path}") from error
    if rows != expected_rows:
        message = f"{path} has {rows} rows, expected {expected_rows}"
        if strict:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return rows


def check_dim(df: DataFrame, expected: int, vector: str = "embedding") -> DataFrame:
    """Rows per embedding size, and whether the size is the expected one."""
    sizes = df.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n_rows"))
    return sizes.withColumn("as_expected", F.col("dim") == expected)

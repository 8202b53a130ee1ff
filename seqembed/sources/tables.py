"""Parquet folders, catalog tables, metadata and lookup files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.positions import file_offsets


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet folder; with `schema` no file is opened to infer one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_first(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first `n` rows of a parquet folder in file order, 0 for all.

    Rows are counted per file first, which reads no column. The driver gets one row, the file in which the limit
    falls and how many of its rows count; a filter on file names leaves later files unopened. Nothing is sorted,
    shuffled or gathered in one task but the counts, one row per file.
    """
    df = spark.read.parquet(path)
    if n <= 0:
        return df
    boundary = file_offsets(df).filter(F.col("before") < n).orderBy(F.desc("file")).limit(1).collect()
    if not boundary:
        return df
    file = F.col("_metadata.file_path")
    last, rest = boundary[0].file, n - boundary[0].before
    return df.filter((file <= last) & ((file < last) | (F.col("_metadata.row_index") < rest)))


def read_table(spark: SparkSession, name: str, *columns: str) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def sql_over_path(spark: SparkSession, path: str) -> DataFrame:
    """Query a parquet folder by its path in SQL."""
    return spark.sql(f"SELECT * FROM parquet.`{path}`")


def smoke_input(spark: SparkSession, n: int = 64) -> DataFrame:
    """Rows `(id, value)` with value = id as a double."""
    return spark.range(n).select("id", F.col("id").cast("double").alias("value"))


def read_lookup(spark: SparkSession, path: str, value: str = "double", key_name: str = "key",
                value_name: str = "value", one_per_line: bool = False) -> DataFrame:
    """JSON objects `{key: value, ...}`, one per file or one per line, as rows `(key, value)`."""
    text = spark.read.text(path, wholetext=not one_per_line)
    parsed = text.select(F.from_json("value", f"map<string,{value}>").alias("entries"))
    return parsed.select(F.explode("entries").alias(key_name, value_name))


def file_stem(path: Column) -> Column:
    """Name of a file without its folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def with_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add `dataset` to rows that carry a `file_name`, from `metadata(file_name, dataset)`.

    A file without metadata gets its own stem.
    """
    named = df.join(metadata.select("file_name", F.col("dataset").alias("_dataset")),
                    "file_name", "left")
    stem = file_stem(F.col("file_name"))
    return named.withColumn("dataset", F.coalesce("_dataset", stem)).drop("_dataset")

"""Parquet, CSV and table writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.positions import file_positions
from ..operators.rows import batch_ids
from ..session import stage


def write_stage(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write parquet, every task its own files; returns the rows written, counted on the way."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return written.get["rows"]


def write_shards(df: DataFrame, path: str, rows: int = 500, order: Sequence[str] = (),
                 mode: str = "errorifexists", exact: bool = False) -> None:
    """Write parquet files of at most `rows` rows, 0 for no bound.

    With `exact` every file but one has exactly `rows` rows: rows are staged, their positions come from the
    counts of the staged files, and whole shards go to a task, which cuts its shards apart again. With `order`
    the shards are also cut in that order, for the price of a sort. Otherwise tasks write what they hold, which
    needs no shuffle.
    """
    if order and rows:
        shards = batch_ids(df, rows, order, name="_shard")
        df = shards.repartition("_shard").sortWithinPartitions("_shard", *order).drop("_shard")
    elif exact and rows:
        shards = file_positions(stage(df, "shards")).withColumn("_shard", F.floor(F.col("_position") / rows))
        df = shards.repartition("_shard").sortWithinPartitions("_shard").drop("_shard", "_position")
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def write_partitioned(df: DataFrame, path: str, column: str = "node",
                      mode: str = "errorifexists") -> int:
    """Write one subfolder per value of `column`; reading `path` gives all of them. Returns the rows written."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).partitionBy(column).parquet(path)
    return written.get["rows"]


def promote(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
            location: str | None = None) -> None:
    """Make the parquet folder `path` a catalog table, replacing what the table held."""
    publish(spark.read.parquet(path), table, fmt, location)


def publish(df: DataFrame, table: str, fmt: str = "parquet", location: str | None = None) -> int:
    """Make the rows of `df` what the catalog table holds; returns their number.

    The rows are written beside the present ones, into a version folder of their own below `location` (by default
    below the folder of the database), read back and counted. Only then the table is pointed there, in one
    statement of the catalog where the columns are the same, so a job that is lost before leaves the table as it
    was. `df` may read the table. Where columns differ the new table takes the name in two renames. Folders of
    versions before the last two are left to whoever cleans `location`.
    """
    spark = df.sparkSession
    name = table.replace("`", "").split(".")
    root = location or f"{_database_folder(spark, name)}/{name[-1]}__versions"
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.format(fmt).save(version)
    rows, found = written.get["rows"], spark.read.format(fmt).schema(df.schema).load(version)
    if found.count() != rows:
        raise ValueError(f"{version} does not hold the {rows} rows written")
    if not spark.catalog.tableExists(table):
        _create(spark, df, table, fmt, version)
    elif [(f.name, f.dataType) for f in spark.table(table).schema] == [(f.name, f.dataType) for f in df.schema]:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
    else:
        mark = uuid.uuid4().hex
        _create(spark, df, f"{table}_{mark}", fmt, version)
        spark.sql(f"ALTER TABLE {table} RENAME TO {table}_old_{mark}")
        spark.sql(f"ALTER TABLE {table}_{mark} RENAME TO {table}")
        spark.sql(f"DROP TABLE {table}_old_{mark}")
    spark.catalog.refreshTable(table)
    return rows


def _create(spark: SparkSession, df: DataFrame, table: str, fmt: str, path: str) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING {fmt} LOCATION '{path}'")


def _database_folder(spark: SparkSession, name: list[str]) -> str:
    database = name[-2] if len(name) > 1 else spark.catalog.currentDatabase()
    return spark.catalog.getDatabase(database).locationUri.rstrip("/")


def wide_columns(dims: int, vector: str = "embedding") -> list:
    """One column per dimension, named 0 to `dims - 1`."""
    return [F.col(vector)[i].alias(str(i)) for i in range(dims)]


def export_csv(df: DataFrame, path: str, dims: int, mode: str = "errorifexists") -> None:
    """Write `embedding` as CSV with a header and one column per dimension."""
    df.select(*wide_columns(dims)).write.mode(mode).csv(path, header=True)


def describe_output(spark: SparkSession, path: str) -> DataFrame:
    """Files of a parquet folder with their row counts."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file_name"))
    return files.groupBy("file_name").agg(F.count("*").alias("n_rows"))

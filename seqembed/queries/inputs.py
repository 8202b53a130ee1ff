"""The job inputs, derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.rows import spread
from ..sources.cells import read_cells
from ..sources.tables import read_stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_stage(spark, f"{folder}/{name}.parquet")


def letters(text: str = "text") -> Column:
    """Upper-case letters of a text."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """`(seq_id, sequence)`: the letters of each document."""
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("seq_id"), letters().alias("sequence"))


LETTERS_SQL = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
SEQUENCES_SQL = f"sequences AS (SELECT 'doc_' || doc_id AS seq_id, {LETTERS_SQL} AS sequence FROM documents)"


COUNT_ROWS = 500_000  # a task adds up; some 150 bytes of memory each


def raw_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per line item: the supplier is the cell, the part the gene, the quantity the count."""
    lines = spread(table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), COUNT_ROWS)
    return lines.select(
        F.col("l_suppkey").cast("string").alias("cell_id"),
        F.col("l_partkey").cast("string").alias("gene_id"), F.col("l_quantity").alias("count"))


def cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_cells(raw_counts(spark, folder))


COUNTS_SQL = """counts AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS cell_id, CAST(l_partkey AS VARCHAR) AS gene_id,
           sum(l_quantity) AS count
    FROM lineitem GROUP BY ALL)"""
NORMALIZED_SQL = f"""{COUNTS_SQL}, totals AS (
    SELECT cell_id, sum(count) AS total FROM counts GROUP BY cell_id),
normalized AS (
    SELECT cell_id, gene_id, count, CASE WHEN total = 0 THEN 0 ELSE count * 10000.0::DOUBLE / total END AS value
    FROM counts JOIN totals USING (cell_id))"""
SCALED_SQL = f"""{NORMALIZED_SQL}, scaled AS (
    SELECT cell_id, gene_id, count, value / coalesce(p_retailprice, 1) AS value
    FROM normalized LEFT JOIN part ON gene_id = CAST(p_partkey AS VARCHAR))"""


def gene_medians(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_retailprice").alias("median"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of the genes; 0 is the padding, 1 and 2 are kept for specials."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("gene_id"),
        (F.col("p_partkey") + 3).cast("int").alias("token_id"))


def util_samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "ts", F.pmod("user_id", F.lit(8)).cast("int").alias("device"),
        F.pmod(F.floor("value"), F.lit(101)).cast("int").alias("util"),
        F.pmod("event_id", F.lit(101)).cast("int").alias("mem"))


UTIL_SQL = """samples AS (
    SELECT ts, user_id % 8 AS device, CAST(floor(value) AS BIGINT) % 101 AS util, event_id % 101 AS mem
    FROM events)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per event type: its events, the seconds they span and the devices they touch."""
    span = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("run_id")).agg(
        F.count("*").alias("rows"), span.cast("double").alias("wall_s"),
        F.count_distinct(F.pmod("user_id", F.lit(8))).alias("workers"))


RUNS_SQL = """runs AS (
    SELECT event_type AS run_id, count(*) AS rows,
           CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS DOUBLE) AS wall_s,
           count(DISTINCT user_id % 8) AS workers
    FROM events GROUP BY event_type)"""


def joined(column: str) -> Column:
    """A list of integers as text, so that every element is compared."""
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)

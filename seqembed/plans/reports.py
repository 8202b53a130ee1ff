"""Throughput, speed-up and utilisation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SATURATED = 90  # percent


def throughput(runs: DataFrame) -> DataFrame:
    """Add rows per second, 0 for no wall time, and the same per worker."""
    rate = F.when(F.col("wall_s") > 0, F.col("rows") / F.col("wall_s")).otherwise(F.lit(0.0))
    return runs.withColumn("rate", rate).withColumn(
        "rate_per_worker", F.col("rate") / F.col("workers"))


def speedup(runs: DataFrame, base_id) -> DataFrame:
    """Add the rate of each run relative to the run `base_id`."""
    rated = throughput(runs)
    base = rated.filter(F.col("run_id") == base_id).select(F.max("rate")).scalar()
    return rated.withColumn("speedup", F.col("rate") / F.nullif(base, F.lit(0.0)))


def eta_minutes(rows: Column, batch_size: int, workers: int, seconds: float = 0.2) -> Column:
    """Planning rule: `seconds` per batch and worker, in minutes."""
    return rows / batch_size * F.lit(seconds) / workers / 60


def util_summary(samples: DataFrame) -> DataFrame:
    """Utilisation and memory of each device."""
    return samples.groupBy("device").agg(
        F.count("*").alias("n_samples"),
        F.avg("util").alias("util_mean"), F.min("util").alias("util_min"),
        F.max("util").alias("util_max"),
        F.avg("mem").alias("mem_mean"), F.max("mem").alias("mem_max"))


def util_overall(samples: DataFrame) -> DataFrame:
    """Mean utilisation and the percentage of samples at 90 or more; nulls without samples."""
    saturated = F.count_if(F.col("util") >= SATURATED) / F.nullif(F.count("*"), F.lit(0)) * 100
    return samples.agg(F.avg("util").alias("util_mean"), saturated.alias("saturation_pct"))

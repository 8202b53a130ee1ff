"""Joins to lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 500_000


def lookup_join(df: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join `df` to a narrow lookup table with one row per `on`.

    The table is counted first. Up to `max_rows` rows it is broadcast, so `df` is not
    shuffled. Above that the join is left to the planner, where adaptive execution splits
    a skewed key of `df`.
    """
    if lookup.count() <= max_rows:
        lookup = F.broadcast(lookup)
    return df.join(lookup, on if isinstance(on, str) else list(on), how)

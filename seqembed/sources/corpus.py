"""Text corpora with optional ids and two possible sequence fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rank import number_rows
from ..operators.rows import limit_rows


def read_corpus(df: DataFrame, order: Sequence[str] = (), n: int = 0, max_len: int | None = 1024,
                prefix: str = "uniref50_", position: str | None = None) -> DataFrame:
    """`(id, text, sequence)` rows to `(seq_id, sequence)`.

    The sequence is `text`, or `sequence` where that is empty; rows with neither are dropped. `n`
    counts raw rows, so fewer may come out. A row without an id is named after its raw position,
    counted from 0. Sequences are cut at `max_len`; None leaves them whole.

    `position` names a column with the raw position, as `file_positions` adds it; then no row moves.
    Without it rows are numbered in `order`.
    """
    body = F.coalesce(F.nullif("text", F.lit("")), F.nullif("sequence", F.lit("")))
    cut = F.substring(body, 1, max_len) if max_len else body
    if position is None:
        raw = limit_rows(df, n, order).select(*order, F.col("id").cast("string").alias("_id"), cut.alias("_body"))
        number = F.lit(None).cast("long")
        if not df.filter(F.col("id").isNull()).isEmpty():
            raw = number_rows(raw, order, name="_row")
            number = F.col("_row") - 1
    else:
        raw = df.filter(F.col(position) < n) if n > 0 else df
        raw = raw.select(F.col("id").cast("string").alias("_id"), cut.alias("_body"), F.col(position).alias("_row"))
        number = F.col("_row")
    return raw.filter(F.col("_body").isNotNull()).select(
        F.coalesce("_id", numbered_id(number, prefix)).alias("seq_id"), F.col("_body").alias("sequence"))


def numbered_id(number: Column, prefix: str, width: int = 6) -> Column:
    """`prefix` and the number, zero-padded to `width` digits and never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))

"""Cell by gene counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def read_cells(df: DataFrame) -> DataFrame:
    """A long `(cell_id, gene_id, count)` table with repeated pairs added up.

    The sum is taken per task before the shuffle, so a cell or gene that fills much of the table
    costs no more than its distinct pairs. A row without a cell or a gene is no count. The filter
    says so in every plan, and lets the branches of a plan share this shuffle.
    """
    keyed = df.filter(F.col("cell_id").isNotNull() & F.col("gene_id").isNotNull())
    return keyed.groupBy("cell_id", "gene_id").agg(F.sum("count").alias("count"))

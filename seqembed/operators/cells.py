"""Cell by gene operators on long tables `(cell_id, gene_id, count or value)`.

Pairs are unique here (see `sources.cells.read_cells`). Only the settings of these steps are
published, not their arithmetic, so each docstring states the definition used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .lookup import BROADCAST_ROWS, lookup_join
from .rank import row_numbers, top_per_group
from .rows import limit_rows


def cell_totals(df: DataFrame) -> DataFrame:
    """Total count and number of detected genes of each cell."""
    return df.groupBy("cell_id").agg(
        F.sum("count").alias("total"), F.count_if(F.col("count") > 0).alias("n_genes"))


def min_genes(df: DataFrame, n: int | None) -> DataFrame:
    """Keep the cells with at least `n` detected genes; None keeps all."""
    if n is None:
        return df
    kept = cell_totals(df).filter(F.col("n_genes") >= n)
    return df.join(kept.select("cell_id"), "cell_id", "left_semi")


def max_mito(df: DataFrame, mito_genes: DataFrame, share: float | None) -> DataFrame:
    """Keep the cells whose listed genes hold at most `share` of the total; None keeps all."""
    if share is None:
        return df
    listed = mito_genes.select("gene_id", F.lit(True).alias("_mito"))
    flagged = lookup_join(df, listed, "gene_id")
    sums = flagged.groupBy("cell_id").agg(
        F.sum(F.when(F.col("_mito"), F.col("count")).otherwise(0.0)).alias("mito"),
        F.sum("count").alias("total"))
    kept = sums.filter(F.col("mito") <= F.lit(share) * F.col("total"))
    return df.join(kept.select("cell_id"), "cell_id", "left_semi")


def normalize_total(df: DataFrame, target: float = 10000.0) -> DataFrame:
    """Add `value`, the counts scaled so that each cell adds up to `target`.

    A cell with total 0 keeps zeros. Totals are joined back instead of taken in a window, so that a
    very large cell is not one task.
    """
    totals = cell_totals(df).select("cell_id", "total")
    scaled = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.col("count") * F.lit(target) / F.col("total"))
    return df.join(totals, "cell_id").withColumn("value", scaled).drop("total")


def log1p(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.log1p("value"))


def gene_medians(df: DataFrame, accuracy: int | None = None, window_rows: int | None = None) -> DataFrame:
    """Median of the non-zero values of each gene; the mean of the middle two for even counts.

    With `accuracy` a value whose rank is off by at most 1 / accuracy of the gene's values: a quantile summary per
    gene, merged in every task before the shuffle. It holds some `accuracy` values whatever the size of the gene,
    and no value is ranked. That is for tables too large to sort; it is asked for, never chosen by size.
    """
    if accuracy is not None:
        median = F.percentile_approx("value", 0.5, accuracy).alias("median")
        return df.filter(F.col("value") > 0).groupBy("gene_id").agg(median)
    present = stage(df.select("gene_id", "cell_id", "value").filter(F.col("value") > 0), "present")
    ranked = row_numbers(present, ["value", "cell_id"], ["gene_id"], name="rank", size="n", window_rows=window_rows)
    middle = (F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (
        F.col("rank") == F.floor(F.col("n") / 2) + 1)
    return ranked.filter(middle).groupBy("gene_id").agg(F.avg("value").alias("median"))


def scale_by_median(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Divide `value` by the gene's median; a gene without one keeps its value."""
    scaled = F.col("value") / F.coalesce("median", F.lit(1.0))
    return (lookup_join(df, medians.select("gene_id", "median"), "gene_id")
            .withColumn("value", scaled).drop("median"))


def hvg(df: DataFrame, k: int) -> DataFrame:
    """The `k` genes with the largest variance to mean ratio over all cells.

    Cells without the gene count as zeros; they enter through the number of cells and are not
    materialised.
    """
    # Counted from the totals, which can share the shuffle of the pairs.
    cells = cell_totals(df).select(F.count("total")).scalar()
    sums = df.groupBy("gene_id").agg(
        F.sum("count").alias("s"), F.count("count").alias("k"), F.var_pop("count").alias("spread"),
    ).withColumn("n", cells)
    s, present, n = F.col("s"), F.col("k"), F.col("n")
    # The squares around the mean of the cells that have the gene, and what the others add: no large sums cancel.
    variance = (F.col("spread") * present + (s / present) * s * (n - present) / n) / (n - 1)
    stats = sums.filter((s > 0) & (n > 1)).select(
        "gene_id", (s / n).alias("mean"), variance.alias("variance"),
        (variance / (s / n)).alias("dispersion"))
    return limit_rows(stats, k, [F.desc("dispersion"), "gene_id"])


def map_tokens(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the `token_id` of each gene; genes outside the vocabulary are dropped."""
    return lookup_join(df, vocab.select("gene_id", "token_id"), "gene_id", "inner")


def annotate(df: DataFrame, maps: dict[str, DataFrame], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Replace the label columns named in `maps` by their mapped labels, null where unmapped."""
    for column, labels in maps.items():
        lookup = labels.select(F.col("label").alias(column), F.col("mapped").alias("_mapped"))
        df = lookup_join(df, lookup, column, max_rows=max_rows).withColumn(column, F.col("_mapped")).drop("_mapped")
    return df


def rank_genes(df: DataFrame, top: int) -> DataFrame:
    """Rank the non-zero genes of each cell by falling value, ties by gene; keep the first `top`."""
    return top_per_group(df.filter(F.col("value") > 0), ["cell_id"],
                         [F.desc("value"), F.col("gene_id")], top, spread=["gene_id"])


def _all_ranks(df: DataFrame, order: list, window_rows: int | None = None) -> DataFrame:
    """Add the `rank` of each non-zero gene of a cell and their number `n`."""
    present = stage(df.filter(F.col("value") > 0), "present")
    return row_numbers(present, order, ["cell_id"], name="rank", size="n", window_rows=window_rows)


def continuous_rank(df: DataFrame, window_rows: int | None = None) -> DataFrame:
    """Add `rank_value` = (n - rank + 1) / n over the non-zero genes of a cell: the largest gets 1."""
    ranked = _all_ranks(df, [F.desc("value"), "gene_id"], window_rows)
    return ranked.withColumn(
        "rank_value", (F.col("n") - F.col("rank") + 1) / F.col("n")).drop("n", "rank")


def bin_values(df: DataFrame, bins: int) -> DataFrame:
    """Add `bin`, 1 to `bins`: equal-frequency bins of the non-zero values of a cell, rising.

    When the sizes cannot be equal the first bins have one gene more.
    """
    ranked = _all_ranks(df, ["value", "gene_id"])
    size = F.floor(F.col("n") / bins)
    longer = F.pmod(F.col("n"), F.lit(bins))
    in_longer = longer * (size + 1)
    index = F.when(F.col("rank") <= in_longer, F.floor((F.col("rank") - 1) / (size + 1))).otherwise(
        longer + F.floor((F.col("rank") - in_longer - 1) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("bin", (index + 1).cast("int")).drop("n", "rank")


def cell_tokens(df: DataFrame, cls_id: int | None = None, annotations: DataFrame | None = None,
                values: str | None = None) -> DataFrame:
    """Ranked `(cell_id, rank, token_id)` rows to `(cell_id, gene_ids)`, in rank order.

    With `values`, a column of `df`, the list `gene_values` beside the ids; tokens in front have the value 0.

    `cls_id` and the `token_id` of `annotations(cell_id, token_id)` go in front when given. A list
    is as long as the cut of `rank_genes` at most.
    """
    held = [F.col(values).cast("double").alias("value")] if values else []
    pairs = F.array_sort(F.collect_list(F.struct("rank", "token_id", *held)))
    lists = df.groupBy("cell_id").agg(pairs.alias("_pairs")).select(
        "cell_id", F.col("_pairs.token_id").alias("gene_ids"), *([F.col("_pairs.value").alias("gene_values")] if values else []))
    if annotations is not None:
        lists = lists.join(annotations.withColumnRenamed("token_id", "_token"), "cell_id", "left")
        lead = F.when(F.col("_token").isNull(), F.array().cast("array<int>")).otherwise(
            F.array(F.col("_token").cast("int")))
        lists = lists.withColumn("gene_ids", F.concat(lead, "gene_ids")).drop("_token")
    if cls_id is not None:
        lists = lists.withColumn("gene_ids", F.concat(F.array(F.lit(cls_id)), "gene_ids"))
    if values:
        zeros = F.array_repeat(F.lit(0.0), F.size("gene_ids") - F.size("gene_values"))
        lists = lists.withColumn("gene_values", F.concat(zeros, "gene_values"))
    return lists

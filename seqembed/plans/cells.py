"""The cell job: counts to token lists to embeddings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import cells as ops
from ..operators.rows import cap_keys, drop_values
from ..session import stage
from ..sources.cells import read_cells
from ..sources.tables import with_metadata


@dataclass
class CellSettings:
    """Settings of the preprocessing and tokenizing steps, with the defaults of the published run.

    `gene_values` adds a value per token, "rank" (the continuous rank) or "bin" (one of `bins`). `annotations`
    (cell_id, token_id) and `cls_id` put tokens in front. `metadata` (file_name, dataset) names the dataset of cells
    whose counts have a `file_name`.
    """

    min_gene_counts: int | None = None
    max_mitochondrial_prop: float | None = None
    mito_genes: DataFrame | None = None
    normalized_total: float = 10000.0
    log1p: bool = False
    compute_medians: bool = False
    median_accuracy: int | None = None
    hvg: int | None = None
    max_seq_len: int = 2048
    remove: dict[str, list] = field(default_factory=dict)
    max_cells: int = 0
    gene_values: str | None = None
    bins: int = 10
    cls_id: int | None = None
    annotations: DataFrame | None = None
    metadata: DataFrame | None = None


def filtered(counts: DataFrame, settings: CellSettings = CellSettings()) -> DataFrame:
    """Raw counts to summed counts `(cell_id, gene_id, count)` of the cells that pass the filters."""
    if settings.max_mitochondrial_prop is not None and settings.mito_genes is None:
        raise ValueError("max_mitochondrial_prop needs mito_genes")
    for column, values in settings.remove.items():
        counts = drop_values(counts, column, values)
    pairs = ops.min_genes(read_cells(counts), settings.min_gene_counts)
    if settings.mito_genes is not None:
        pairs = ops.max_mito(pairs, settings.mito_genes, settings.max_mitochondrial_prop)
    return pairs


def preprocess(counts: DataFrame, medians: DataFrame | None = None,
               settings: CellSettings = CellSettings()) -> DataFrame:
    """Raw counts to scaled values `(cell_id, gene_id, count, value)`."""
    return preprocess_pairs(filtered(counts, settings), medians, settings)


def preprocess_pairs(pairs: DataFrame, medians: DataFrame | None = None,
                     settings: CellSettings = CellSettings()) -> DataFrame:
    """`preprocess` from what `filtered` returns."""
    if settings.hvg:
        pairs = pairs.join(ops.hvg(pairs, settings.hvg).select("gene_id"), "gene_id", "left_semi")
    values = ops.normalize_total(pairs, settings.normalized_total)
    if settings.compute_medians:
        values = stage(values, "values")
        medians = stage(ops.gene_medians(values, settings.median_accuracy), "medians")
    if medians is not None:
        values = ops.scale_by_median(values, medians)
    return ops.log1p(values) if settings.log1p else values


def all_cells(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Token lists of all cells of `pairs`; a cell without a token gets an empty list."""
    whole = pairs.select("cell_id").distinct().join(lists, "cell_id", "left")
    for column in set(lists.columns) & {"gene_ids", "gene_values"}:
        whole = whole.withColumn(column, F.coalesce(column, F.array().cast(lists.schema[column].dataType)))
    return whole


def cap_cells(lists: DataFrame, settings: CellSettings) -> DataFrame:
    """The first `max_cells` cells of the token lists, so filters, medians and variable genes see all cells."""
    return cap_keys(lists, "cell_id", settings.max_cells) if settings.max_cells else lists


def token_table(values: DataFrame, vocab: DataFrame, settings: CellSettings) -> DataFrame:
    """Scaled values to `(cell_id, gene_ids)`, with `gene_values` and tokens in front as the settings ask for."""
    mapped = ops.map_tokens(values, vocab)
    if settings.gene_values == "rank":
        mapped = ops.continuous_rank(mapped).withColumnRenamed("rank_value", "gene_value")
    elif settings.gene_values == "bin":
        mapped = ops.bin_values(mapped, settings.bins).withColumnRenamed("bin", "gene_value")
    elif settings.gene_values is not None:
        raise ValueError(f"unknown gene values {settings.gene_values!r}")
    ranked = ops.rank_genes(mapped, settings.max_seq_len)
    return ops.cell_tokens(ranked, settings.cls_id, settings.annotations, "gene_value" if settings.gene_values else None)


def datasets(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """`(cell_id, dataset)` of counts with a `file_name`; of several files the first name."""
    named = with_metadata(counts.select("cell_id", "file_name").distinct(), metadata)
    return named.groupBy("cell_id").agg(F.min("dataset").alias("dataset"))


def token_lists(values: DataFrame, vocab: DataFrame, max_seq_len: int = 2048) -> DataFrame:
    """Scaled values to `(cell_id, gene_ids)`."""
    return ops.cell_tokens(ops.rank_genes(ops.map_tokens(values, vocab), max_seq_len))

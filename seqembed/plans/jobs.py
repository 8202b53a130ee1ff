"""The jobs from input to output: stage, pretokenize, embed, embed a table, cells, smoke."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.batches import Doubler, map_batches
from ..functions.models import StandIn
from ..functions.tokenize import tokenize
from ..operators.lengths import length_stats
from ..operators.positions import file_positions
from ..operators.rows import hash_split, limit_rows
from ..schemas import SMOKE_OUT
from ..session import cleaned_up, stage
from ..sinks.files import describe_output, export_csv, publish, write_partitioned, write_shards, write_stage
from ..sources.corpus import read_corpus
from ..sources.fasta import read_fasta
from ..sources.synth import synth_sequences
from ..sources.tables import read_first, smoke_input
from .cells import CellSettings, all_cells, cap_cells, datasets, filtered, preprocess_pairs, token_table
from .embed import embed, embed_cells
from .guards import check_dim, preflight


@dataclass
class RunReport:
    """What an embedding run did."""

    input_rows: int
    output_rows: int
    wall_s: float
    workers: int

    @property
    def rate(self) -> float:
        return self.output_rows / self.wall_s if self.wall_s > 0 else 0.0

    def as_dict(self) -> dict:
        return {**asdict(self), "rate": self.rate, "rate_per_worker": self.rate / self.workers}


@cleaned_up
def stage_job(spark: SparkSession, source: str, output: str, path: str | None = None, n: int | None = None,
              max_len: int | None = 1024, min_len: int = 50, mean_len: int = 200, seed: int = 42,
              shard_rows: int = 0, exact_shards: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Stage sequences as parquet shards; returns their count and lengths.

    `n` is the number of rows, all when left out; synthetic sequences are 1,000 then. `max_len` cuts
    sequences; with None they stay whole. Shards have `shard_rows` rows at most, 0 leaves that to Spark;
    `exact_shards` makes all but one have exactly as many, for the price of a shuffle.

    `source` is "corpus" (parquet with `id`, `text`, `sequence`), "fasta" or "synthetic".
    """
    if source == "corpus":
        # File order: the rows are those the first `n` of the files hold.
        raw = read_first(spark, path, n or 0)
        rows = file_positions(raw)
        for field in {"id", "text", "sequence"} - set(raw.columns):
            rows = rows.withColumn(field, F.lit(None).cast("string"))
        df = read_corpus(rows, max_len=max_len, position="_position")
    elif source == "fasta":
        df = read_fasta(spark, path, n=n or 0, max_len=max_len)
    elif source == "synthetic":
        df = synth_sequences(spark, 1000 if n is None else n, min_len=min_len, max_len=max_len or 1024, mean_len=mean_len, seed=seed)
    else:
        raise ValueError(f"unknown source {source!r}")
    write_shards(df, output, shard_rows, mode=mode, exact=exact_shards)
    return length_stats(spark.read.parquet(output))


@cleaned_up
def pretokenize_job(spark: SparkSession, path: str, output: str, n: int = 0, max_length: int = 1024,
                    shard_rows: int = 0, mode: str = "errorifexists") -> None:
    """Tokenize staged sequences to fixed-width token parquet."""
    tokens = tokenize(read_first(spark, path, n), max_length)
    write_shards(tokens, output, shard_rows, mode=mode)


@cleaned_up
def embed_job(spark: SparkSession, path: str, output: str, model: Callable = StandIn(), limit: int = 0,
              batch_size: int = 32, max_length: int = 1024, pretokenized: bool = False, nodes: int = 1,
              workers: int | None = None, mode: str = "errorifexists",
              profile: ResourceProfile | None = None) -> RunReport:
    """Embed staged sequences or tokens, with checks before and after.

    With `nodes` above 1 the output has one subfolder per node; read `output` for all of them. The
    output is compared with what was read, after `limit`.
    """
    total = preflight(spark, path).count()
    expected = min(limit, total) if limit > 0 else total
    started = time.perf_counter()
    vectors = embed(read_first(spark, path, limit), model, max_length, batch_size, pretokenized,
                    workers=workers, profile=profile)
    if nodes > 1:
        rows = write_partitioned(hash_split(vectors, nodes, "seq_id"), output, mode=mode)
    else:
        rows = write_stage(vectors, output, mode)
    wall = time.perf_counter() - started
    if rows != expected:
        raise ValueError(f"{output} has {rows} rows, expected {expected}")
    return RunReport(expected, rows, wall, workers or spark.sparkContext.defaultParallelism)


@cleaned_up
def embed_table_job(spark: SparkSession, source: str, target: str, dims: int, model: Callable = StandIn(),
                    limit: int = 0, batch_size: int = 32, max_length: int = 1024, fmt: str = "parquet",
                    location: str | None = None, profile: ResourceProfile | None = None) -> bool:
    """Embed the rows of a catalog table that another one lacks; False when there are none.

    Done is what has an embedding of `dims` elements in the target; rows with others are replaced. New
    embeddings are staged and checked before they are added, so a run with wrong `dims` raises and leaves
    the target as it was. Rows without an id are embedded once, in the run that makes the table.
    """
    rows = limit_rows(spark.table(source).select("seq_id", "sequence"), limit, ["seq_id"])
    exists, wrong = spark.catalog.tableExists(target), False
    if exists:
        done = spark.table(target)
        good = done.filter(F.size("embedding") == dims)
        wrong = not done.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dims).isEmpty()
        rows = rows.filter("seq_id IS NOT NULL").join(good.select("seq_id"), "seq_id", "left_anti")
        if rows.isEmpty() and not wrong:
            return False
    vectors = stage(embed(rows, model, max_length, batch_size, profile=profile), "vectors")
    if check_dim(vectors, dims).filter(~F.col("as_expected")).count():
        raise ValueError(f"the model's embeddings do not have {dims} elements")
    if exists and not wrong:
        vectors.write.mode("append").format(fmt).saveAsTable(target)
    else:
        publish(good.unionByName(vectors) if wrong else vectors, target, fmt, location)
    return True


@cleaned_up
def cell_job(spark: SparkSession, counts: DataFrame, vocab: DataFrame, output: str,
             medians: DataFrame | None = None, settings: CellSettings = CellSettings(),
             model: Callable = StandIn(), dims: int | None = None, batch_size: int = 4,
             mode: str = "errorifexists", profile: ResourceProfile | None = None, tokens: str | None = None) -> DataFrame:
    """Embed cells from raw counts; parquet at `output`, and CSV beside it when `dims` is given.

    `tokens` is a folder that keeps the token lists for later runs. With metadata the output names the dataset.

    Every cell that passes the filters is embedded; one without a token is all padding. Raises when the
    output does not have them all.
    """
    pairs = stage(filtered(counts, settings), "pairs")
    lists = token_table(preprocess_pairs(pairs, medians, settings), vocab, settings)
    lists = cap_cells(all_cells(lists, pairs), settings)
    if tokens:
        write_stage(lists, tokens, mode)
        lists = spark.read.parquet(tokens)
    else:
        lists = stage(lists, "token-lists")
    vectors = embed_cells(lists, model, settings.max_seq_len, batch_size, profile=profile)
    if settings.metadata is not None:
        vectors = vectors.join(datasets(counts, settings.metadata), "cell_id", "left")
    rows, expected = write_stage(vectors, output, mode), lists.count()
    if rows != expected:
        raise ValueError(f"{output} has {rows} rows, expected {expected}")
    written = spark.read.parquet(output)
    if dims is not None:
        export_csv(written, f"{output}.csv", dims, mode)
    return written


def smoke_job(spark: SparkSession, output: str, workers: int | None = 2,
              mode: str = "errorifexists") -> DataFrame:
    """Double 64 values in a batch function, write them, and describe what was written."""
    doubled = map_batches(smoke_input(spark), Doubler(), SMOKE_OUT, batch_size=8, workers=workers)
    write_stage(doubled, output, mode)
    described = describe_output(spark, output)
    if described.agg(F.sum("n_rows")).first()[0] != 64:
        raise ValueError(f"{output} does not hold the 64 rows written")
    return described

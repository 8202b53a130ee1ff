"""Command line: python -m seqembed stage | pretokenize | embed | table | cells | smoke."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession, functions as F

from .functions.models import StandIn
from .plans import jobs
from .plans.cells import CellSettings
from .sources.tables import read_lookup


def _model(name: str):
    if name == "stand-in":
        return StandIn()
    module, factory = name.split(":")
    return getattr(importlib.import_module(module), factory)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqembed")
    commands = parser.add_subparsers(dest="command", required=True)

    stage = commands.add_parser("stage", help="write sequences as parquet shards")
    stage.add_argument("--source", choices=["corpus", "fasta", "synthetic"], default="corpus")
    stage.add_argument("--input")
    stage.add_argument("--n", type=int, help="rows; all when left out, 1,000 synthetic ones")
    stage.add_argument("--max-len", type=int, default=1024, help="0: whole sequences")
    stage.add_argument("--min-len", type=int, default=50)
    stage.add_argument("--mean-len", type=int, default=200)
    stage.add_argument("--seed", type=int, default=42)
    stage.add_argument("--shard-rows", type=int, default=0)
    stage.add_argument("--exact-shards", action="store_true")

    tokens = commands.add_parser("pretokenize", help="write token parquet")
    tokens.add_argument("--input", required=True)
    tokens.add_argument("--max-length", type=int, default=1024)
    tokens.add_argument("--n", type=int, default=0)
    tokens.add_argument("--shard-rows", type=int, default=0)

    embed = commands.add_parser("embed", help="write embedding parquet")
    embed.add_argument("--input", required=True)
    embed.add_argument("--limit", type=int, default=0)
    embed.add_argument("--batch-size", type=int, default=32)
    embed.add_argument("--max-length", type=int, default=1024)
    embed.add_argument("--nodes", type=int, default=1)
    embed.add_argument("--workers", type=int)
    embed.add_argument("--pretokenized", action="store_true")

    table = commands.add_parser("table", help="embed the rows of a catalog table that another one lacks")
    table.add_argument("--source", required=True)
    table.add_argument("--target", required=True)
    table.add_argument("--dims", type=int, required=True)
    table.add_argument("--limit", type=int, default=0)
    table.add_argument("--batch-size", type=int, default=32)
    table.add_argument("--max-length", type=int, default=1024)
    table.add_argument("--location")

    cells = commands.add_parser("cells", help="embed cells from parquet of counts")
    cells.add_argument("--counts", required=True, help="parquet: cell_id, gene_id, count")
    cells.add_argument("--vocab", required=True, help="parquet: gene_id, token_id")
    cells.add_argument("--medians", help="JSON: gene to median")
    cells.add_argument("--metadata", help="parquet: file_name, dataset")
    cells.add_argument("--annotations", help="parquet: cell_id, token_id")
    cells.add_argument("--tokens", help="folder that keeps the token lists")
    cells.add_argument("--max-seq-len", type=int, default=2048)
    cells.add_argument("--max-cells", type=int, default=0)
    cells.add_argument("--min-genes", type=int)
    cells.add_argument("--hvg", type=int)
    cells.add_argument("--cls-id", type=int)
    cells.add_argument("--gene-values", choices=["rank", "bin"])
    cells.add_argument("--bins", type=int, default=10)
    cells.add_argument("--log1p", action="store_true")
    cells.add_argument("--compute-medians", action="store_true")
    cells.add_argument("--batch-size", type=int, default=4)
    cells.add_argument("--dims", type=int, help="also write CSV with so many columns")

    for command in (embed, table, cells):
        command.add_argument("--model", required=True, help="module:name of a model factory, or stand-in")

    smoke = commands.add_parser("smoke", help="check that batches reach the workers and come back")
    smoke.add_argument("--workers", type=int, default=2)

    for command in (stage, tokens, embed, cells, smoke):
        command.add_argument("--output", required=True)
        command.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    mode = "overwrite" if getattr(args, "overwrite", False) else "errorifexists"
    spark = SparkSession.builder.appName(f"seqembed {args.command}").getOrCreate()

    if args.command == "stage":
        stats = jobs.stage_job(spark, args.source, args.output, args.input, args.n, args.max_len or None, args.min_len,
                               args.mean_len, args.seed, args.shard_rows, args.exact_shards, mode)
        print(json.dumps(stats.first().asDict()))
    elif args.command == "pretokenize":
        jobs.pretokenize_job(spark, args.input, args.output, args.n, args.max_length, args.shard_rows, mode)
    elif args.command == "embed":
        report = jobs.embed_job(spark, args.input, args.output, _model(args.model), args.limit, args.batch_size, args.max_length,
                                args.pretokenized, args.nodes, args.workers, mode)
        print(json.dumps(report.as_dict()))
    elif args.command == "table":
        done = jobs.embed_table_job(spark, args.source, args.target, args.dims, _model(args.model), args.limit, args.batch_size,
                                    args.max_length, location=args.location)
        print(json.dumps({"embedded": done, "rows": spark.table(args.target).count()}))
    elif args.command == "cells":
        settings = CellSettings(
            min_gene_counts=args.min_genes, log1p=args.log1p, compute_medians=args.compute_medians, hvg=args.hvg,
            max_seq_len=args.max_seq_len, max_cells=args.max_cells, gene_values=args.gene_values, bins=args.bins, cls_id=args.cls_id,
            annotations=spark.read.parquet(args.annotations) if args.annotations else None,
            metadata=spark.read.parquet(args.metadata) if args.metadata else None)
        counts = spark.read.parquet(args.counts)
        if args.metadata:
            counts = counts.withColumn("file_name", F.col("_metadata.file_name"))
        medians = read_lookup(spark, args.medians, key_name="gene_id", value_name="median") if args.medians else None
        written = jobs.cell_job(spark, counts, spark.read.parquet(args.vocab), args.output, medians, settings, _model(args.model),
                                args.dims, args.batch_size, mode, tokens=args.tokens)
        print(json.dumps({"cells": written.count()}))
    else:
        jobs.smoke_job(spark, args.output, args.workers, mode).show(truncate=False)


if __name__ == "__main__":
    main()

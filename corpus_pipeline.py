"""A corpus from documents to token ids, in five stages.

Each stage is called with (spark, docs, sf_dir) and returns a DataFrame; `run` writes what it returns as Parquet
in the shared folder and hands the reread table to the next one. All but the last return the columns of
`documents`. Missing and empty texts pass through every stage: they are not toxic, equal ones are copies of
each other, and they give no ids. Very long texts are handled whole by every stage; repeated rows are copies, and of
rows with one id one stays. Further columns pass through all stages but the last, which keeps `doc_id`, `lang` and
`source` and needs them. Without documents the result has no rows.

The stages learn and gather what they need from the documents that they are given: toxicity fits on the training
part of `labels`, and the near-duplicate stage compares all documents that are left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqembed.llm import bpe, decontaminate, secrets, simhash, toxicity
from seqembed.llm.common import read, stage


def _measured(docs: DataFrame) -> DataFrame:
    """`n_chars` anew, as texts have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays: four words, four bits."""
    return simhash.keep_one(docs, shingle=4, budget=4)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _measured(decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    words = secrets.shared(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return _measured(secrets.redact(docs, words))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with their number and whether they decode to the text."""
    vocabulary = bpe.shared(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    source = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    encoded, ids = bpe.encode(source, vocabulary)
    decoded, data = bpe.decode(encoded, vocabulary, ids)
    return decoded.select("doc_id", "lang", "source", F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n_tokens"),
                          (F.sha2(data, 256) == F.col("text_sha256")).alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenize),
]

#: Trees, token merges and guess costs are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

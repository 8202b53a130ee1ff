"""The registered queries of this folder, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, centroids, decontaminate, itq, mixing, pii, secrets, sentencepieces, shards, simhash, substrings, toxicity
from .common import read

QUERIES, SQL = {}, {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


@registered
def op3_suffix_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against the windows of ten words of every benchmark item."""
    return decontaminate.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@registered
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by the multilingual byte vocabulary and decoded again."""
    vocabulary = bpe.shared(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.report(read(spark, folder, "documents"), vocabulary)


@registered
def op8_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.report(read(spark, folder, "documents"))


@registered
def op5_toxicity_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the training part of the labels."""
    return toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@registered
def op9_secret_guess_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    words = secrets.shared(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return secrets.report(read(spark, folder, "documents"), words)


@registered
def op4_count_min_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated windows of 35 words."""
    return substrings.report(read(spark, folder, "documents"))


@registered
def op6_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards.report(read(spark, folder, "documents"))


SQL["op6_feistel_shards"] = shards.report_sql()


@registered
def op1_itq_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of every embedding."""
    return itq.report(read(spark, folder, "embeddings"))


@registered
def op10_disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document and the terms that give it away."""
    return pii.report(read(spark, folder, "documents"))


@registered
def op2_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Word and mixing scores of every document."""
    return mixing.report(read(spark, folder, "documents"), fold=True)


@registered
def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by the piece model and decoded again."""
    model = sentencepieces.shared(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.report(read(spark, folder, "documents"), model)


@registered
def op12_rotated_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every embedding of 64 components."""
    return centroids.report(read(spark, folder, "embeddings"))


SQL["op12_rotated_centroids"] = centroids.report_sql()


@registered
def op13_merge_path_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under two tokenizers, cut into groups at common ends."""
    tokenizers = alignment.shared(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                  public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.report(read(spark, folder, "documents"), tokenizers)

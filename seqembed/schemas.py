"""Declared schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

SEQUENCES = T.StructType([
    T.StructField("seq_id", T.StringType(), False),
    T.StructField("sequence", T.StringType()),
])

TOKENS = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
])

EMBEDDINGS = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CELL_COUNTS = T.StructType([
    T.StructField("cell_id", T.StringType()),
    T.StructField("gene_id", T.StringType()),
    T.StructField("count", T.DoubleType()),
])

SMOKE_IN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

SMOKE_OUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("doubled", T.DoubleType()),
    T.StructField("device", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("compile", T.BooleanType()),
    T.StructField("block", T.StringType()),
    T.StructField("pretok", T.BooleanType()),
    T.StructField("rows", T.LongType()),
    T.StructField("wall_s", T.DoubleType()),
    T.StructField("workers", T.IntegerType()),
])

UTILISATION = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("device", T.IntegerType()),
    T.StructField("util", T.IntegerType()),
    T.StructField("mem", T.IntegerType()),
])

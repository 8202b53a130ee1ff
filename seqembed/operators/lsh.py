"""Approximate k nearest neighbours by cosine: hyperplane signatures, equi-joined buckets, exact re-rank.

A vector's signature in a table is the side of each of the table's drawn hyperplanes on which it lies; vectors are
compared when they share the first `bits` of it in some table. There are enough bits that a bucket holds some
`bucket_rows` rows. How many tables that takes is measured: a sample of `SAMPLE` rows is searched in all rows, and
tables are added until the wanted share of the neighbours found shares a bucket in one of them; where `MAX_TABLES`
are not enough, a bit is given up. Vectors with near neighbours need few tables. Vectors without structure need
many, and there the exact search is the better choice.

A bucket of more than twice `bucket_rows` rows is ordered by the distance to one more hyperplane and cut into equal
slices; each slice is searched together with the next one. So no unit outgrows `2 * bucket_rows` rows, whatever is
alike, and near rows of a large bucket still meet. A unit keeps the `k` best of it per row, ties by the smallest
id; similarities are exact. Equal vectors are one row. Nothing compares all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.arrays import list_column
from ..session import stage
from .neighbors import QUERY_ROWS, SIM_DIGITS, best_columns, finished, matrix, prepared, unit_rows
from .rank import largest_group, row_numbers, top_per_group

SAMPLE = 64
CENTRE = 1024
MAX_TABLES = 128
MOST_BITS = 40


class Planes:
    """Hyperplanes through the middle of the vectors, drawn per table from a seed; `spare` is one more plane per table."""

    def __init__(self, middle: np.ndarray, bits: int, tables: int, seed: int):
        self.middle, self.bits, self.tables, self.seed = middle, bits, tables, seed

    def drawn(self, table: int) -> np.ndarray:
        return np.random.default_rng([self.seed, table]).normal(size=(MOST_BITS + 1, len(self.middle)))

    def keys(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each row in each table, and its side distance to the table's spare plane."""
        keys, side = (np.empty((len(units), self.tables), kind) for kind in (np.int64, np.float64))
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        for table in range(self.tables):
            planes = self.drawn(table)
            placed = (units - self.middle) @ np.concatenate([planes[:self.bits], planes[-1:]]).T
            keys[:, table], side[:, table] = (placed[:, :-1] > 0) @ weights, placed[:, -1]
        return keys, side


class _Sign:
    """(rep, vector) to (rep, buckets, sides), one element per table."""

    def __init__(self, planes):
        self.planes = planes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, side = self.planes.value.keys(unit_rows(matrix(batch.column("vector"), len(self.planes.value.middle))))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), list_column(keys), list_column(side)],
                                                 names=["rep", "keys", "sides"])


class _Bucket:
    """The k best of a bucket for each of its rows."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        units = unit_rows(matrix(table["vector"]))
        rows, columns, near = [], [], []
        for start in range(0, len(units), QUERY_ROWS):
            part = units[start:start + QUERY_ROWS]
            sims = np.round(part @ units.T, SIM_DIGITS)
            sims[np.arange(len(part)), start + np.arange(len(part))] = -np.inf
            row, column, _ = best_columns(sims, self.k)
            rows.append(start + row)
            columns.append(column)
            near.append(sims[row, column])
        rows, columns = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
        names = table["rep"].combine_chunks()
        return pa.table([names.take(rows), names.take(columns), table["first"].combine_chunks().take(columns),
                         pa.array(np.concatenate(near))], names=["rep", "other", "first", "sim"])


class _Against:
    """(rep, first, vector) to the k best of a batch for each row of a bounded sample."""

    def __init__(self, sample, k: int):
        self.sample, self.k = sample, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, units = self.sample.value
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("first")
            names = batch.column("rep")
            sims = np.round(units @ unit_rows(matrix(batch.column("vector"), units.shape[1])).T, SIM_DIGITS)
            at = {name: i for i, name in enumerate(names.to_pylist())}
            for row, rep in enumerate(reps):
                if rep in at:
                    sims[row, at[rep]] = -np.inf
            row, column, _ = best_columns(sims, self.k)
            column_ = pa.array(column)
            yield pa.RecordBatch.from_arrays([
                pa.array(reps, pa.string()).take(pa.array(row)), names.take(column_), batch.column("first").take(column_),
                pa.array(sims[row, column]), batch.column("vector").take(column_)],
                names=["rep", "other", "first", "sim", "vector"])


def best_of_sample(nodes: DataFrame, sample: tuple[list[str], np.ndarray], k: int) -> DataFrame:
    """`(rep, other, first, sim, vector)`: the `k` best of all `nodes` for each row of a sample that is broadcast."""
    spark = nodes.sparkSession
    schema = T.StructType([T.StructField("rep", T.StringType()), T.StructField("other", T.StringType()),
                           T.StructField("first", nodes.schema["first"].dataType), T.StructField("sim", T.DoubleType()),
                           nodes.schema["vector"]])
    hits = nodes.mapInArrow(_Against(spark.sparkContext.broadcast(sample), k), schema)
    return top_per_group(hits, ["rep"], [F.desc("sim"), F.asc_nulls_last("first")], k, spread=["other"])


def planes_for(nodes: DataFrame, total: int, k: int, recall: float, bucket_rows: int, seed: int) -> Planes | None:
    """As many bits as the buckets' size asks for, and as many tables as the sample needs; None without rows."""
    found = nodes.orderBy("rep").limit(CENTRE).select("rep", "vector").collect()
    if not found:
        return None
    if len({len(row.vector) for row in found}) > 1:
        raise ValueError("vectors have different lengths")
    units = unit_rows(np.array([row.vector for row in found], np.float64))
    reps = [row.rep for row in found[:SAMPLE]]
    near = best_of_sample(nodes, (reps, units[:SAMPLE]), k).select("rep", "vector").collect()  # SAMPLE times k rows
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, total) / bucket_rows))))
    middle = units.mean(axis=0)
    if not near:
        return Planes(middle, bits, 1, seed)
    left = units[[reps.index(row.rep) for row in near]]
    right = unit_rows(np.array([row.vector for row in near], np.float64))
    while True:
        planes = Planes(middle, bits, MAX_TABLES, seed)
        met = np.logical_or.accumulate(planes.keys(left)[0] == planes.keys(right)[0], axis=1).mean(axis=0)
        if met[-1] >= recall or bits == 1:
            tables = int(np.argmax(met >= recall)) + 1 if met[-1] >= recall else MAX_TABLES
            return Planes(middle, bits, tables, seed)
        bits -= 1


def _units(signed: DataFrame, bucket_rows: int) -> DataFrame:
    """`(table, key, part, rep)`: the units in which each row is searched."""
    entries = signed.select("rep", F.posexplode(F.arrays_zip("keys", "sides")).alias("table", "e")).select(
        "rep", "table", F.col("e.keys").alias("key"), F.col("e.sides").alias("side"))
    if largest_group(entries, ["table", "key"]) <= 2 * bucket_rows:
        return entries.select("table", "key", F.lit(0).alias("part"), "rep")
    entries = stage(entries, "lsh-entries")
    ranked = row_numbers(entries, ["side", "rep"], ["table", "key"], name="place", size="n")
    slices = F.when(F.col("n") <= 2 * bucket_rows, 1).otherwise(F.ceil(F.col("n") / bucket_rows))
    part = F.floor((F.col("place") - 1) * slices / F.col("n")).cast("int")
    ranked = ranked.select("table", "key", "rep", part.alias("own"), slices.cast("int").alias("slices"))
    # A slice is searched with the one before it and the one after it.
    parts = F.array_distinct(F.array(F.greatest(F.col("own") - 1, F.lit(0)), F.least("own", F.greatest(F.col("slices") - 2, F.lit(0)))))
    return ranked.select("table", "key", F.explode(parts).alias("part"), "rep")


def knn_lsh(df: DataFrame, k: int = 15, id_column: str = "vec_id", vector: str = "embedding", recall: float = 0.95,
            bucket_rows: int = 4096, seed: int = 0) -> DataFrame:
    """`(id, rank, neighbor, cosine)`: nearly the `k` most similar other rows of each row.

    Rows, ties and vectors without a cosine are handled as by `knn_cosine`. `recall` is the share of the true
    neighbours that buckets should bring together, as measured on the sample.
    """
    rows, nodes, total = prepared(df, id_column, vector)
    return finished(rows, lsh_hits(nodes, total, k, recall, bucket_rows, seed), k, id_column)


def lsh_hits(nodes: DataFrame, total: int, k: int, recall: float, bucket_rows: int, seed: int) -> DataFrame:
    """`(rep, other, first, sim)`: the `k` best of what the buckets bring together."""
    spark = nodes.sparkSession
    schema = T.StructType([T.StructField("rep", T.StringType()), T.StructField("other", T.StringType()),
                           T.StructField("first", nodes.schema["first"].dataType), T.StructField("sim", T.DoubleType())])
    planes = planes_for(nodes, total, k, recall, bucket_rows, seed)
    if planes is None:
        return spark.createDataFrame([], schema)
    signed = stage(nodes.select("rep", "vector").mapInArrow(
        _Sign(spark.sparkContext.broadcast(planes)), "rep string, keys array<long>, sides array<double>"), "lsh-signed")
    search = _Bucket(k)
    units = _units(signed, bucket_rows).join(nodes, "rep")
    hits = units.groupBy("table", "key", "part").applyInArrow(lambda table: search(table.drop_columns(["table", "key", "part"])), schema)
    # A pair that several tables bring together is one hit: equal ranks, of which one is kept.
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), F.asc_nulls_last("first"), F.col("other"))
    near = hits.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return near.dropDuplicates(["rep", "other"]).drop("rank")


def knn_lsh_recall(df: DataFrame, k: int = 15, id_column: str = "vec_id", vector: str = "embedding", every: int = 100,
                   measured: int = 256, recall: float = 0.95, bucket_rows: int = 4096, seed: int = 0) -> DataFrame:
    """`(id, n_exact, n_found, recall)` for rows whose id is divisible by `every`: how many of their `k` best are found.

    At most `measured` different vectors of such rows, those of the smallest hashes, are searched by brute force in
    all rows; `recall` is the share found over all of them.
    """
    spark = df.sparkSession
    rows, nodes, total = prepared(df, id_column, vector)
    hits = stage(lsh_hits(nodes, total, k, recall, bucket_rows, seed), "lsh-hits")
    asked = rows.filter(F.col("id") % every == 0).select("id", "rep")
    drawn = nodes.join(asked.select("rep").distinct(), "rep").orderBy("rep").limit(measured).select("rep", "vector").collect()
    if not drawn:
        return spark.createDataFrame([], T.StructType([
            T.StructField(id_column, rows.schema["id"].dataType), T.StructField("n_exact", T.LongType()),
            T.StructField("n_found", T.LongType()), T.StructField("recall", T.DoubleType())]))
    sample = ([row.rep for row in drawn], unit_rows(np.array([row.vector for row in drawn], np.float64)))
    exact = best_of_sample(nodes, sample, k).select("rep", "other")
    both = exact.join(hits.select("rep", "other").withColumn("found", F.lit(1)), ["rep", "other"], "left")
    counts = stage(both.groupBy("rep").agg(F.count("*").alias("n_exact"), F.count("found").alias("n_found")), "lsh-recall")
    share = counts.agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    return asked.join(F.broadcast(counts), "rep").select(
        F.col("id").alias(id_column), "n_exact", "n_found", F.lit(share).cast("double").alias("recall"))

"""Embeddings, pooling, neighbours and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.batches import Doubler, map_batches
from ..functions.pooling import pool_column
from ..functions.tokenize import tokenize
from ..operators.lsh import knn_lsh_recall
from ..operators.neighbors import knn_cosine
from ..operators.projection import pca_2d
from ..plans.embed import embed, embed_whole
from ..schemas import SMOKE_OUT
from ..session import scratch_path
from ..sinks.files import export_csv
from .inputs import SEQUENCES_SQL, sequences, table
from .sequences import RESIDUES_BY_ID, TOKENS_SQL

DIMS = 64


def per_dim(df, key):
    """One row per embedding element."""
    elements = df.select(key, F.posexplode("embedding").alias("dim", "value"))
    return elements.select(key, "dim", F.col("value").cast("double").alias("value"))


def smoke_double(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("id"), "value")
    return map_batches(rows, Doubler(), SMOKE_OUT, batch_size=1024)


def embed_sequences(spark, folder):
    return per_dim(embed(sequences(spark, folder)), "seq_id")


def whole_texts(spark, folder):
    return per_dim(embed_whole(sequences(spark, folder)), "seq_id")


def whole_texts_split(spark, folder):
    """Parts of two windows, dealt over all tasks and merged."""
    return per_dim(embed_whole(sequences(spark, folder), split_windows=2), "seq_id")


def embed_pretokenized(spark, folder):
    return per_dim(embed(tokenize(sequences(spark, folder)), pretokenized=True), "seq_id")


EMBED_SQL = f"""
WITH {SEQUENCES_SQL}, {TOKENS_SQL}, dims AS (SELECT CAST(range AS INT) AS dim FROM range({DIMS})),
sums AS (
    SELECT seq_id, dim, sum((31 * token + 17 * dim + 7 * position) % 1009) AS total, count(*) AS n
    FROM tokens, dims GROUP BY seq_id, dim)
SELECT seq_id, dim, CAST(CAST(total AS FLOAT) / CAST(n AS FLOAT) AS DOUBLE) AS value FROM sums"""


# Windows of 1,022 residues between cls (0) and eos (2), positions counted anew in each.
WHOLE_SQL = f"""
WITH {SEQUENCES_SQL},
letters AS (
    SELECT seq_id, unnest(string_split(sequence, '')) AS letter,
           generate_subscripts(string_split(sequence, ''), 1) - 1 AS i FROM sequences),
windows AS (
    SELECT seq_id, CAST(unnest(range(0, greatest(1, (length(sequence) + 1021) // 1022))) AS BIGINT) AS w, length(sequence) AS size
    FROM sequences),
tokens AS (
    SELECT seq_id, i % 1022 + 1 AS position, strpos('{RESIDUES_BY_ID}', letter) + 3 AS token FROM letters WHERE letter <> ''
    UNION ALL SELECT seq_id, 0, 0 FROM windows
    UNION ALL SELECT seq_id, least(1022, size - 1022 * w) + 1, 2 FROM windows),
dims AS (SELECT CAST(range AS INT) AS dim FROM range({DIMS})),
sums AS (
    SELECT seq_id, dim, sum((31 * token + 17 * dim + 7 * position) % 1009) AS total, count(*) AS n
    FROM tokens, dims GROUP BY seq_id, dim)
SELECT seq_id, dim, CAST(CAST(CAST(total AS DOUBLE) / n AS FLOAT) AS DOUBLE) AS value FROM sums"""


def _positions(spark, folder):
    """Each embedding as eight positions of eight dims; a position counts where it starts positive."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    hidden = F.array(*[F.slice("v", 8 * i + 1, 8) for i in range(8)])
    mask = F.array(*[(F.col("v")[8 * i] > 0).cast("int") for i in range(8)])
    return vectors.select("vec_id", hidden.alias("hidden"), mask.alias("mask"))


def _rounded(df):
    return per_dim(df, "vec_id").withColumn("value", F.round("value", 9))


def pool_masked(spark, folder):
    pooled = pool_column(F.col("hidden"), F.col("mask"))
    return _rounded(_positions(spark, folder).select("vec_id", pooled.alias("embedding")))


def pool_unmasked(spark, folder):
    return _rounded(_positions(spark, folder).select("vec_id", pool_column(F.col("hidden")).alias("embedding")))


_POOL_SQL = """
WITH dims AS (SELECT CAST(range AS INT) AS dim FROM range(8)),
positions AS (SELECT CAST(range AS INT) AS position FROM range(8)),
elements AS (
    SELECT vec_id, dim, embedding[8 * position + dim + 1]::DOUBLE AS x,
           CASE WHEN embedding[8 * position + 1] > 0 THEN 1 ELSE 0 END AS m
    FROM embeddings, dims, positions)
SELECT vec_id, dim, round({value}, 9) AS value FROM elements GROUP BY vec_id, dim"""


def csv_wide(spark, folder):
    path = scratch_path(spark, "csv")
    export_csv(table(spark, folder, "embeddings"), path, DIMS)
    fields = ", ".join(f"`{i}` float" for i in range(DIMS))
    back = spark.read.schema(fields).csv(path, header=True)
    return back.select(*[F.col(f"`{i}`").cast("double").alias(str(i)) for i in range(DIMS)])


def neighbours(spark, folder):
    near = knn_cosine(table(spark, folder, "embeddings"), k=15)
    return near.withColumn("cosine", F.round("cosine", 6))


def neighbours_blocks(spark, folder):
    """Small blocks, so rows visit other blocks as they do on large data."""
    near = knn_cosine(table(spark, folder, "embeddings"), k=15, block_rows=64)
    return near.withColumn("cosine", F.round("cosine", 6))


def lsh_recall(spark, folder):
    """How many of the 15 exact neighbours the buckets bring together."""
    return knn_lsh_recall(table(spark, folder, "embeddings"), k=15)


def projection(spark, folder):
    points = pca_2d(table(spark, folder, "embeddings"))
    return points.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# The covariance matrix, squared again and again, tends to the projection on its first axis; less that axis, to the
# second. The column of the largest diagonal element has that element, the largest loading, positive.
_TRACE = "list_sum(list_transform(range(1, {n} + 1), lambda i: {p}[i][i]))".replace("{n}", str(DIMS))
_POWERS = """{name} AS (
    SELECT 0 AS k, {start} AS p {source}
    UNION ALL
    SELECT k + 1, list_transform(p, lambda r: list_transform(p, lambda q: list_dot_product(r, q) / t / t))
    FROM (SELECT k, p, {trace} AS t FROM {name}) AS before WHERE k < 45)"""
_AXIS = """{name} AS MATERIALIZED (
    SELECT list_transform(p, lambda r: r[i] / sqrt(p[i][i])) AS v
    FROM (SELECT p, list_position(d, list_max(d)) AS i
          FROM (SELECT p, list_transform(range(1, {n} + 1), lambda i: p[i][i]) AS d
                FROM (SELECT list_transform(p, lambda r: list_transform(r, lambda x: x / {trace})) AS p
                      FROM {source} WHERE k = 45))))"""
PCA_SQL = f"""
WITH RECURSIVE elements AS MATERIALIZED (
    SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS z
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
cells AS (
    SELECT a.i AS i, b.i AS j, sum(a.z * b.z) AS s FROM elements a JOIN elements b USING (vec_id) GROUP BY a.i, b.i),
covariance AS MATERIALIZED (
    SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(s ORDER BY j) AS r FROM cells GROUP BY i)),
{_POWERS.format(name="first_powers", start="c", source="FROM covariance", trace=_TRACE.format(p="p"))},
{_AXIS.format(name="first_axis", n=DIMS, source="first_powers", trace=_TRACE.format(p="p"))},
rest AS MATERIALIZED (
    SELECT list_transform(range(1, {DIMS} + 1), lambda i: list_transform(range(1, {DIMS} + 1), lambda j: c[i][j] - e * v[i] * v[j])) AS c
    FROM (SELECT c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS e FROM covariance, first_axis)),
{_POWERS.format(name="second_powers", start="c", source="FROM rest", trace=_TRACE.format(p="p"))},
{_AXIS.format(name="second_axis", n=DIMS, source="second_powers", trace=_TRACE.format(p="p"))},
points AS (SELECT vec_id, list(z ORDER BY i) AS z FROM elements GROUP BY vec_id)
SELECT vec_id, round(list_dot_product(z, first_axis.v), 6) AS x, round(list_dot_product(z, second_axis.v), 6) AS y
FROM points, first_axis, second_axis"""


QUERIES = {
    "smoke_double": smoke_double,
    "embed_sequences": embed_sequences,
    "embed_pretokenized": embed_pretokenized,
    "embed_whole": whole_texts,
    "embed_whole_split": whole_texts_split,
    "pool_masked": pool_masked,
    "pool_unmasked": pool_unmasked,
    "csv_wide": csv_wide,
    "knn_cosine": neighbours,
    "knn_cosine_blocks": neighbours_blocks,
    "knn_lsh_recall": lsh_recall,
    "pca_2d": projection,
}

SQL = {
    "smoke_double": "SELECT event_id AS id, value * 2 AS doubled, 'cpu' AS device FROM events",
    "embed_sequences": EMBED_SQL,
    "embed_pretokenized": EMBED_SQL,
    "embed_whole": WHOLE_SQL,
    "embed_whole_split": WHOLE_SQL,
    "pool_masked": _POOL_SQL.format(value="sum(x * m) / greatest(sum(m), 1)"),
    "pool_unmasked": _POOL_SQL.format(value="sum(x) / count(*)"),
    "csv_wide": "SELECT " + ", ".join(
        f'CAST(embedding[{i + 1}] AS DOUBLE) AS "{i}"' for i in range(DIMS)) + " FROM embeddings",
    "knn_cosine": """
        WITH pairs AS (
            SELECT a.vec_id AS vec_id, b.vec_id AS neighbor,
                   round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS sim
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor) AS INT) AS rank
            FROM pairs)
        SELECT vec_id, rank, neighbor, round(sim, 6) AS cosine FROM ranked WHERE rank <= 15""",
}
SQL["pca_2d"] = PCA_SQL
SQL["knn_cosine_blocks"] = SQL["knn_cosine"]

"""Cell queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.models import StandIn
from ..operators import cells as ops
from ..operators.lookup import BROADCAST_ROWS
from ..operators.rows import cap_keys, drop_values
from ..plans.cells import CellSettings, all_cells, filtered, preprocess, preprocess_pairs, token_lists
from ..plans.embed import embed_cells
from ..plans.jobs import cell_job
from ..session import scratch_path
from .embedding import DIMS, per_dim
from .inputs import (COUNTS_SQL, NORMALIZED_SQL, SCALED_SQL, cell_counts, gene_medians, joined, raw_counts,
                     table, vocabulary)

TOP = 256
SEQ_LEN = 512


def normalized(spark, folder):
    return ops.normalize_total(cell_counts(spark, folder))


def scaled(spark, folder):
    return preprocess(raw_counts(spark, folder), gene_medians(spark, folder))


def cell_cap(spark, folder):
    return cap_keys(cell_counts(spark, folder), "cell_id", 50)


def cells_drop_values(spark, folder):
    """Counts without the return flags listed, and without the suppliers in debt."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("gene"),
        F.col("l_quantity").alias("count"), F.col("l_returnflag").alias("assay"))
    kept = drop_values(lines, "assay", ["A"])
    in_debt = table(spark, folder, "supplier").filter(F.col("s_acctbal") < 0)
    return drop_values(kept, "s_suppkey", in_debt).groupBy("s_suppkey", "assay").agg(
        F.sum("count").alias("count"), F.count("*").alias("n"))


def cells_min_genes(spark, folder):
    return ops.min_genes(cell_counts(spark, folder), 500)


def cells_max_mito(spark, folder):
    mito = table(spark, folder, "part").filter(F.col("p_brand") == "Brand#1").select(
        F.col("p_partkey").cast("string").alias("gene_id"))
    return ops.max_mito(cell_counts(spark, folder), mito, 0.04)


def gene_median(spark, folder):
    return ops.gene_medians(normalized(spark, folder))


SUMMARY = 100


def gene_medians_sketch(spark, folder):
    """Medians from summaries, with the share of the gene's values by which their exact rank is off."""
    values = normalized(spark, folder).filter(F.col("value") > 0)
    medians = ops.gene_medians(values, accuracy=SUMMARY).withColumnRenamed("median", "guess")
    ranks = values.join(medians, "gene_id").groupBy("gene_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < F.col("guess")).alias("below"),
        F.count_if(F.col("value") <= F.col("guess")).alias("up_to"))
    middle = F.ceil(F.col("n") / 2)
    off = F.greatest(F.lit(0), F.col("below") + 1 - middle, middle - F.col("up_to"))
    return ranks.select("gene_id", "n", (off <= F.floor(F.col("n") / SUMMARY) + 1).alias("within"))


def hvg_topk(spark, folder):
    top = ops.hvg(cell_counts(spark, folder), 200)
    return top.select("gene_id", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "dispersion")])


def lookup_unbroadcast(spark, folder):
    """The same with lookups too large for a broadcast."""
    return cell_annotate(spark, folder, max_rows=0)


def cell_annotate(spark, folder, max_rows=BROADCAST_ROWS):
    """Labels of each supplier from its nation, mapped by tables made of nations and regions."""
    nations = table(spark, folder, "nation")
    named = nations.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    labels = table(spark, folder, "supplier").join(
        F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    cells = labels.select(
        F.col("s_suppkey").cast("string").alias("cell_id"), F.col("n_name").alias("disease"),
        F.col("n_name").alias("tissue"), F.col("s_name").alias("cell"),
        F.when(F.col("s_acctbal") < 0, "neg").otherwise("pos").alias("sex"))
    label = F.col("n_name").alias("label")
    maps = {
        "disease": named.select(label, F.concat_ws("_", "r_name", "n_name").alias("mapped")),
        "tissue": named.filter(F.col("r_name") != "ASIA").select(label, F.col("r_name").alias("mapped")),
        "cell": table(spark, folder, "supplier").select(
            F.col("s_name").alias("label"), F.regexp_replace("s_name", "^.*#0*", "cell ").alias("mapped")),
        "sex": table(spark, folder, "supplier").agg(
            F.lit("neg").alias("label"), F.concat(F.lit("below "), F.count("*")).alias("mapped")),
    }
    return ops.annotate(cells, maps, max_rows)


def cell_log1p(spark, folder):
    return ops.log1p(normalized(spark, folder)).select("cell_id", "gene_id", F.round("value", 9).alias("value"))


def cell_rank_tokens(spark, folder):
    lists = token_lists(scaled(spark, folder), vocabulary(spark, folder), TOP)
    return lists.select("cell_id", joined("gene_ids"))


def cell_rank_tokens_long(spark, folder):
    """A cut above the group limit of the optimizer: cells are ranked in slices first."""
    lists = token_lists(scaled(spark, folder), vocabulary(spark, folder), 2048)
    return lists.select("cell_id", joined("gene_ids"))


def cells_all_kept(spark, folder):
    """Cells without a count above zero, and a vocabulary of half the genes: every cell stays."""
    counts = raw_counts(spark, folder)
    pairs = filtered(counts.withColumn("count", F.when(F.col("cell_id").cast("long") % 5 == 0, 0.0).otherwise(F.col("count"))))
    values = preprocess_pairs(pairs, gene_medians(spark, folder))
    lists = token_lists(values, vocabulary(spark, folder).filter("gene_id % 2 = 0"), TOP)
    return all_cells(lists, pairs).select("cell_id", joined("gene_ids"))


def cell_continuous_rank(spark, folder):
    ranked = ops.continuous_rank(scaled(spark, folder))
    return ranked.select("cell_id", "gene_id", F.round("rank_value", 12).alias("rank_value"))


def cell_ranks_split(spark, folder):
    """The ranks as for cells too large for one task."""
    ranked = ops.continuous_rank(scaled(spark, folder), window_rows=0)
    return ranked.select("cell_id", "gene_id", F.round("rank_value", 12).alias("rank_value"))


def gene_medians_split(spark, folder):
    """The medians as for genes too large for one task."""
    return ops.gene_medians(normalized(spark, folder), window_rows=0)


def cell_bins(spark, folder):
    return ops.bin_values(scaled(spark, folder), 10).select("cell_id", "gene_id", "bin")


def cell_embeddings(spark, folder):
    lists = token_lists(scaled(spark, folder), vocabulary(spark, folder), SEQ_LEN)
    return per_dim(embed_cells(lists, seq_len=SEQ_LEN), "cell_id")


def cell_job_whole(spark, folder):
    """The whole job: scaled counts, ranks as values, tokens in front, stored token lists, embeddings, datasets."""
    counts = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("cell_id"), F.col("l_partkey").cast("string").alias("gene_id"),
        F.col("l_quantity").alias("count"), F.col("_metadata.file_name").alias("file_name"))
    front = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("cell_id"), (F.col("s_nationkey") + 100).cast("int").alias("token_id"))
    unnamed = table(spark, folder, "supplier").select(F.col("s_name").alias("file_name"), F.col("s_name").alias("dataset"))
    settings = CellSettings(max_seq_len=64, gene_values="rank", cls_id=1, annotations=front, metadata=unnamed)
    out, tokens = scratch_path(spark, "cells"), scratch_path(spark, "cell-tokens")
    written = cell_job(spark, counts, vocabulary(spark, folder), out, gene_medians(spark, folder), settings, StandIn(4), tokens=tokens)
    sums = spark.read.parquet(tokens).select("cell_id", F.size("gene_ids").alias("n_tokens"), F.round(F.aggregate(
        "gene_values", F.lit(0.0), lambda total, x: total + x), 6).alias("rank_sum"))
    return written.join(sums, "cell_id").select(
        "cell_id", "dataset", "n_tokens", "rank_sum", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


QUERIES = {
    "cell_counts": cell_counts,
    "cell_job_whole": cell_job_whole,
    "cell_ranks_split": cell_ranks_split,
    "gene_medians_split": gene_medians_split,
    "lookup_unbroadcast": lookup_unbroadcast,
    "cell_cap": cell_cap,
    "cells_drop_values": cells_drop_values,
    "cells_min_genes": cells_min_genes,
    "cells_max_mito": cells_max_mito,
    "cell_normalize": normalized,
    "gene_medians": gene_median,
    "gene_medians_sketch": gene_medians_sketch,
    "hvg_topk": hvg_topk,
    "cell_median_scale": scaled,
    "cell_annotate": cell_annotate,
    "cell_log1p": cell_log1p,
    "cell_rank_tokens": cell_rank_tokens,
    "cell_rank_tokens_long": cell_rank_tokens_long,
    "cells_all_kept": cells_all_kept,
    "cell_continuous_rank": cell_continuous_rank,
    "cell_bins": cell_bins,
    "embed_cells": cell_embeddings,
}

_RANKED_SQL = f"""{SCALED_SQL}, ranked AS (
    SELECT cell_id, gene_id, value,
           row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS rank,
           count(*) OVER (PARTITION BY cell_id) AS n
    FROM scaled WHERE value > 0)"""
_TOKEN_SQL = f"""{SCALED_SQL}, ranked AS (
    SELECT cell_id, p_partkey + 3 AS token,
           row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS rank
    FROM scaled JOIN part ON gene_id = CAST(p_partkey AS VARCHAR) WHERE value > 0)"""
_SPARSE_SQL = _TOKEN_SQL.replace(
    "sum(l_quantity)", "sum(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_quantity END)").replace(
    "WHERE value > 0", "WHERE value > 0 AND p_partkey % 2 = 0")

SQL = {
    "cell_counts": f"WITH {COUNTS_SQL} SELECT * FROM counts",
    "cell_cap": f"""
        WITH {COUNTS_SQL}, kept AS (SELECT DISTINCT cell_id FROM counts ORDER BY cell_id LIMIT 50)
        SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM kept)""",
    "cells_drop_values": """
        SELECT l_suppkey AS s_suppkey, l_returnflag AS assay, sum(l_quantity) AS count, count(*) AS n
        FROM lineitem WHERE l_returnflag <> 'A'
          AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY ALL""",
    "cells_min_genes": f"""
        WITH {COUNTS_SQL} SELECT * FROM counts WHERE cell_id IN (
            SELECT cell_id FROM counts GROUP BY cell_id HAVING count(*) FILTER (count > 0) >= 500)""",
    "cells_max_mito": f"""
        WITH {COUNTS_SQL}, kept AS (
            SELECT cell_id FROM counts LEFT JOIN part
                ON gene_id = CAST(p_partkey AS VARCHAR) AND p_brand = 'Brand#1'
            GROUP BY cell_id HAVING coalesce(sum(count) FILTER (p_partkey IS NOT NULL), 0) <= 0.04::DOUBLE * sum(count))
        SELECT * FROM counts WHERE cell_id IN (SELECT cell_id FROM kept)""",
    "cell_normalize": f"WITH {NORMALIZED_SQL} SELECT * FROM normalized",
    "gene_medians": f"""
        WITH {NORMALIZED_SQL}, ranked AS (
            SELECT gene_id, value, row_number() OVER (PARTITION BY gene_id ORDER BY value, cell_id) AS rank,
                   count(*) OVER (PARTITION BY gene_id) AS n
            FROM normalized WHERE value > 0)
        SELECT gene_id, avg(value) AS median FROM ranked
        WHERE rank IN ((n + 1) // 2, n // 2 + 1) GROUP BY gene_id""",
    "gene_medians_sketch": f"""
        WITH {NORMALIZED_SQL} SELECT gene_id, count(*) AS n, true AS within FROM normalized
        WHERE value > 0 GROUP BY gene_id""",
    "hvg_topk": f"""
        WITH {COUNTS_SQL}, sums AS (
            SELECT gene_id, sum(count) AS s, sum(count * count) AS ss,
                   (SELECT count(DISTINCT cell_id) FROM counts) AS n
            FROM counts GROUP BY gene_id),
        stats AS (
            SELECT gene_id, s / n AS mean, (ss - s * s / n) / (n - 1) AS variance,
                   (ss - s * s / n) / (n - 1) / (s / n) AS dispersion FROM sums WHERE s > 0 AND n > 1)
        SELECT gene_id, round(mean, 9) AS mean, round(variance, 9) AS variance, round(dispersion, 9) AS dispersion
        FROM stats ORDER BY stats.dispersion DESC, gene_id LIMIT 200""",
    "cell_median_scale": f"WITH {SCALED_SQL} SELECT * FROM scaled",
    "cell_annotate": """
        SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, r_name || '_' || n_name AS disease,
               nullif(r_name, 'ASIA') AS tissue, regexp_replace(s_name, '^.*#0*', 'cell ') AS cell,
               CASE WHEN s_acctbal < 0 THEN 'below ' || (SELECT count(*) FROM supplier) END AS sex
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "cell_log1p": f"WITH {NORMALIZED_SQL} SELECT cell_id, gene_id, round(ln(1 + value), 9) AS value FROM normalized",
    "cell_rank_tokens": f"""
        WITH {_TOKEN_SQL} SELECT cell_id, string_agg(token, ',' ORDER BY rank) AS gene_ids
        FROM ranked WHERE rank <= {TOP} GROUP BY cell_id""",
    "cell_rank_tokens_long": f"""
        WITH {_TOKEN_SQL} SELECT cell_id, string_agg(token, ',' ORDER BY rank) AS gene_ids
        FROM ranked WHERE rank <= 2048 GROUP BY cell_id""",
    "cells_all_kept": f"""
        WITH {_SPARSE_SQL} SELECT c.cell_id, coalesce(string_agg(token, ',' ORDER BY rank), '') AS gene_ids
        FROM (SELECT DISTINCT cell_id FROM counts) c LEFT JOIN ranked r ON r.cell_id = c.cell_id AND rank <= {TOP}
        GROUP BY c.cell_id""",
    "cell_continuous_rank": f"""
        WITH {_RANKED_SQL} SELECT cell_id, gene_id, round((n - rank + 1) / n, 12) AS rank_value FROM ranked""",
    "cell_bins": f"""
        WITH {SCALED_SQL} SELECT cell_id, gene_id,
            CAST(ntile(10) OVER (PARTITION BY cell_id ORDER BY value, gene_id) AS INT) AS bin
        FROM scaled WHERE value > 0""",
    "embed_cells": f"""
        WITH {_TOKEN_SQL}, kept AS (SELECT cell_id, rank - 1 AS position, token FROM ranked WHERE rank <= {SEQ_LEN}),
        places AS (
            SELECT cell_id, CAST(range AS BIGINT) AS position
            FROM (SELECT DISTINCT cell_id FROM kept), range({SEQ_LEN})),
        padded AS (
            SELECT cell_id, position, coalesce(token, 0) AS token
            FROM places LEFT JOIN kept USING (cell_id, position)),
        dims AS (SELECT CAST(range AS INT) AS dim FROM range({DIMS})),
        sums AS (
            SELECT cell_id, dim, sum((31 * token + 17 * dim + 7 * position) % 1009) AS total
            FROM padded, dims GROUP BY cell_id, dim)
        SELECT cell_id, dim, CAST(CAST(total AS FLOAT) / CAST({SEQ_LEN} AS FLOAT) AS DOUBLE) AS value FROM sums""",
}
SQL["cell_ranks_split"] = SQL["cell_continuous_rank"]
SQL["gene_medians_split"] = SQL["gene_medians"]
SQL["lookup_unbroadcast"] = SQL["cell_annotate"]
SQL["cell_job_whole"] = f"""
    WITH {_TOKEN_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM ranked),
    kept AS (SELECT cell_id, rank + 1 AS position, token, (n - rank + 1) / n AS share FROM sized WHERE rank <= 64),
    tokens AS (
        SELECT cell_id, position, token FROM kept WHERE position < 64
        UNION ALL SELECT DISTINCT cell_id, 0, 1 FROM kept
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, s_nationkey + 100 FROM supplier
                  WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT cell_id FROM kept)),
    padded AS (
        SELECT cell_id, position, coalesce(token, 0) AS token
        FROM (SELECT cell_id, CAST(range AS BIGINT) AS position FROM (SELECT DISTINCT cell_id FROM counts), range(64))
        LEFT JOIN tokens USING (cell_id, position)),
    sums AS (
        SELECT cell_id, CAST(d.range AS INT) AS dim, sum((31 * token + 17 * d.range + 7 * position) % 1009) AS total
        FROM padded, range(4) AS d GROUP BY ALL),
    stored AS (SELECT cell_id, CAST(count(*) + 2 AS INT) AS n_tokens, round(sum(share), 6) AS rank_sum FROM kept GROUP BY cell_id)
    SELECT cell_id, 'lineitem' AS dataset, coalesce(n_tokens, 0) AS n_tokens, coalesce(rank_sum, 0) AS rank_sum, dim,
           CAST(CAST(total AS FLOAT) / CAST(64 AS FLOAT) AS DOUBLE) AS value
    FROM sums LEFT JOIN stored USING (cell_id)"""

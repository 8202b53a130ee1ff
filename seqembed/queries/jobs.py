"""Guards, checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.embed import embed
from ..plans.guards import already_done, check_dim, postflight, preflight, reconcile
from ..plans.jobs import embed_table_job, stage_job
from ..plans.reports import eta_minutes, speedup, throughput, util_overall, util_summary
from ..session import scratch_path
from ..sinks.files import promote, write_stage
from .inputs import RUNS_SQL, SEQUENCES_SQL, UTIL_SQL, runs, sequences, table, util_samples


def preflight_count(spark, folder):
    return preflight(spark, f"{folder}/documents.parquet").agg(F.count("*").alias("n_rows"))


def skip_guard(spark, folder):
    path = scratch_path(spark, "guard")
    write_stage(sequences(spark, folder), path)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    missing = already_done(spark, name)
    promote(spark, path, name, location=scratch_path(spark, "guard-table"))
    done = already_done(spark, name)
    return spark.table(name).agg(
        F.lit(missing).alias("before"), F.lit(done).alias("after"), F.count("*").alias("n_rows"))


def stage_all(spark, folder):
    """The staging job without a limit or a cut."""
    path, out = scratch_path(spark, "corpus"), scratch_path(spark, "staged")
    write_stage(sequences(spark, folder).selectExpr("seq_id AS id", "sequence AS text", "'' AS sequence"), path)
    stage_job(spark, "corpus", out, path, max_len=None)
    return spark.read.parquet(out)


def table_resume(spark, folder):
    """A limited table job and a full one after it; the tables' entries are dropped, their files stay staged."""
    place = scratch_path(spark, "resumed")
    source, target = (scratch_path(spark, name).rsplit("/", 1)[1].replace("-", "_") for name in ("from", "to"))
    sequences(spark, folder).write.option("path", scratch_path(spark, "source")).saveAsTable(source)
    again = [embed_table_job(spark, source, target, 64, limit=limit, location=place) for limit in (120, 0, 0)]
    rows = spark.table(target)
    spark.sql(f"DROP TABLE {source}")
    rows = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    spark.sql(f"DROP TABLE {target}")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("seq_id").alias("n_ids"), F.min(F.size("embedding")).alias("dim"),
        F.lit(again[1]).alias("resumed"), F.lit(again[2]).alias("again"))


def count_reconcile(spark, folder):
    source = sequences(spark, folder)
    path = scratch_path(spark, "embedded")
    written = write_stage(embed(source), path)
    postflight(spark, path, written)
    return reconcile(source, spark.read.parquet(path))


def dim_check(spark, folder):
    return check_dim(table(spark, folder, "embeddings"), 64)


def util_by_device(spark, folder):
    return util_summary(util_samples(spark, folder))


def overall(spark, folder):
    return util_overall(util_samples(spark, folder))


def rates(spark, folder):
    return throughput(runs(spark, folder))


def relative(spark, folder):
    return speedup(runs(spark, folder), "click").select("run_id", F.round("speedup", 9).alias("speedup"))


def eta(spark, folder):
    per_source = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n_rows"))
    return per_source.withColumn("minutes", F.round(eta_minutes(F.col("n_rows"), 32, 8), 12))


QUERIES = {
    "preflight_count": preflight_count,
    "skip_guard": skip_guard,
    "stage_all": stage_all,
    "table_resume": table_resume,
    "count_reconcile": count_reconcile,
    "dim_check": dim_check,
    "util_by_device": util_by_device,
    "util_overall": overall,
    "throughput": rates,
    "speedup": relative,
    "eta": eta,
}

_RATES_SQL = f"""{RUNS_SQL}, rated AS (
    SELECT *, CASE WHEN wall_s > 0 THEN rows / wall_s ELSE 0 END AS rate FROM runs)"""

SQL = {
    "preflight_count": "SELECT count(*) AS n_rows FROM documents",
    "skip_guard": "SELECT false AS before, count(*) > 100 AS after, count(*) AS n_rows FROM documents",
    "stage_all": f"WITH {SEQUENCES_SQL} SELECT seq_id, sequence FROM sequences WHERE sequence <> ''",
    "table_resume": """
        SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, 64 AS dim, count(*) > 120 AS resumed, false AS again
        FROM documents""",
    "count_reconcile": """
        SELECT count(*) AS input_rows, count(*) AS output_rows, true AS matches FROM documents""",
    "dim_check": """
        SELECT CAST(len(embedding) AS INT) AS dim, count(*) AS n_rows, len(embedding) = 64 AS as_expected
        FROM embeddings GROUP BY ALL""",
    "util_by_device": f"""
        WITH {UTIL_SQL} SELECT CAST(device AS INT) AS device, count(*) AS n_samples,
            avg(util) AS util_mean, CAST(min(util) AS INT) AS util_min, CAST(max(util) AS INT) AS util_max,
            avg(mem) AS mem_mean, CAST(max(mem) AS INT) AS mem_max FROM samples GROUP BY device""",
    "util_overall": f"""
        WITH {UTIL_SQL} SELECT avg(util) AS util_mean,
            count(*) FILTER (util >= 90) / count(*) * 100 AS saturation_pct FROM samples""",
    "throughput": f"WITH {_RATES_SQL} SELECT *, rate / workers AS rate_per_worker FROM rated",
    "speedup": f"""
        WITH {_RATES_SQL} SELECT run_id,
            round(rate / (SELECT max(rate) FROM rated WHERE run_id = 'click'), 9) AS speedup FROM rated""",
    "eta": """
        SELECT source, count(*) AS n_rows, round(count(*) / 32 * 0.2::DOUBLE / 8 / 60, 12) AS minutes
        FROM documents GROUP BY source""",
}

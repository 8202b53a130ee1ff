"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from seqembed.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(cells, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(row) for row in df.collect()])
    assert got[1] or name == "cells_min_genes"  # no cell of the smallest tables has 500 genes
    if name in SQL:
        result = duck.execute(SQL[name])
        assert got == canonical([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["seq_id", "embedding"]
    assert df.count() == 200


def test_only_the_measured_recall_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"knn_lsh_recall"}


def test_missing_libraries_leave_the_other_queries():
    """With a library of the optional folder hidden, the rest is still there."""
    import subprocess
    import sys
    from pathlib import Path
    code = ("import sys; sys.modules['xxhash'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; "
            "from seqembed.queries import all_queries; assert set(e.queries()) == set(all_queries()) and len(e.queries()) > 58")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])

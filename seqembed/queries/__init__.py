"""Registered queries: each takes (spark, data folder) and has, where SQL can say it, the same in SQL."""

from . import cells, embedding, jobs, sequences

MODULES = (sequences, embedding, cells, jobs)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

"""Connected components of a distributed graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stage


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`(node, component)` for every node on a link; `component` is the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest
    one, then its smaller neighbours to the smallest one. The graph shrinks to stars whose centres are the
    smallest nodes. A step is one aggregation, whose partial sums precede the shuffle, and one join, whose
    hot keys adaptive execution can split; each step is staged, so lost executors cost one step at most.
    Missing ends and links of a node to itself are left out; repeated links count once.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    edges = _distinct(links.filter(f"{left} IS NOT NULL AND {right} IS NOT NULL").select(high.alias("a"), low.alias("b")))
    edges, seen = _staged(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _distinct(both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large, _ = _staged(large)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                                 F.col("m").alias("b"))
        small, now = _staged(_distinct(small))
        if now == seen:
            break
        edges, seen = small, now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The staged edges with a checksum of the set."""
    edges = stage(edges, "links")
    total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                      F.bit_xor(F.xxhash64("b", "a")))
    return edges, tuple(total.first())


def forest(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """For nodes 0 to count - 1 the smallest node that they reach over the links left-right."""
    label = np.arange(count)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label

"""Connected components of a distributed edge list by alternating star contractions.

Each round points the neighbours of every node at the smallest id around it, first the larger neighbours, then the smaller
ones.  Rounds are written to the shared folder; the number of rounds grows with the logarithm of the longest path.
Minima are folded in the map tasks, and the joins that carry them back read written tables, so a node with a large part
of all edges can be split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    """Edge lists with equal marks are equal."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller end here."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (u, v); the component is its smallest id."""
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "cc-edges")
    before = _mark(edges)
    while True:
        edges = staged(_large_star(edges), "cc-edges")
        edges = staged(_small_star(edges), "cc-edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def smallest_keys(groups: DataFrame, classes: DataFrame, number: str, key: str, name: str) -> DataFrame:
    """(number, name) of the numbers in ``groups`` (id, component): the smallest key of any class of the component; NULL keys
    count only where there is no other."""
    groups = groups.select(F.col("id").alias(number), "component")
    least = staged(groups.join(classes.select(number, key), number).groupBy("component").agg(
        F.min(key).alias(name)), "cc-keys")
    return groups.join(least, "component").select(number, name)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y) that connect the same of n nodes as the links (a, b), fewer than n of them: each node and the smallest
    node of its component.  Labels are lowered along the links until they stand still."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]

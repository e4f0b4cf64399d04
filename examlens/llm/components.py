"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlens.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("least"))
    return (
        both.join(least, "high")
        .where(F.col("low") > F.col("high"))
        .select(F.col("low").alias("high"), F.least("high", "least").alias("low"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = (
        edges.join(least, "high")
        .where(F.col("low") != F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
    )
    return least.select("high", F.col("least").alias("low")).union(moved).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node that has an edge to another: the smallest node reachable.

    Edges are undirected; loops, repeats and edges with a missing end count for nothing. Every
    round is written, so that lost executors cost one round; the driver sees two numbers per
    round. A hub's edges are split by the skew join because each round aggregates before it
    joins. The number of rounds grows with the logarithm of the longest path. The result omits
    nodes without edges.
    """
    a, b = F.col(left), F.col(right)
    current = written(
        edges.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(),
        "components",
    )
    before = None
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")
        ).first()
        if not state.n or state == before:
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = state
        current = written(_small_star(_large_star(current)), "components")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked row to the least row of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]

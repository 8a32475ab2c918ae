"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import dropped, saved


def _downwards(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, then its smaller ones, linked to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node that has a link in ``a, b``.

    Each round is three aggregations and two joins on the nodes; a node with
    very many links is one row on the aggregated side, so that the join can split
    the other. The number of rounds grows with the logarithm of the longest path.
    """
    now = saved(_downwards(edges), "links")
    state = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = now.agg(state.alias("v")).first()["v"]
    while before["n"]:
        after = saved(_stars(now), "links")
        told = after.agg(state.alias("v")).first()["v"]
        dropped(now)
        now = after
        if told == before:
            break
        before = told
    links = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("component").alias("node"), "component").distinct()
    return links.unionByName(roots)


class Forest:
    """Least members of the groups of some nodes, joined a row of links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while True:
            further = self.parent[found]
            if (further == found).all():
                return found
            found = further

    def join(self, node: int, others: np.ndarray) -> None:
        nodes = np.append(others, node)
        roots = self.roots(nodes)
        least = roots.min()
        self.parent[roots] = least
        self.parent[nodes] = least

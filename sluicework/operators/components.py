"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.session import written


SALTS = 8


class Forest:
    """Which of a task's own nodes, numbered from 0, are connected so far."""

    def __init__(self) -> None:
        self.parent, self.n = np.arange(1024), 0

    def grown(self, by: int) -> int:
        """The number of the first of ``by`` new nodes."""
        first, self.n = self.n, self.n + by
        if self.n > len(self.parent):
            self.parent = np.concatenate([self.parent, np.arange(len(self.parent), 2 * self.n)])
        return first

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while not np.array_equal(above := self.parent[found], found):
            found = above
        self.parent[nodes] = found
        return found

    def joining(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of links (a, b) that join what was apart: over all calls fewer than nodes. The closure stays that of all links."""
        places = [np.zeros(0, np.int64)]
        left = np.arange(len(a))
        while len(left):
            x, y = self.roots(a[left]), self.roots(b[left])
            apart = x != y
            left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            one, first = np.unique(high, return_index=True)
            self.parent[one] = low[first]
            places.append(left[first])
        return np.concatenate(places)


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of least (a, m). A node of very many edges is dealt by ``SALTS`` parts of them."""
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = _with_least(edges, least).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pairs.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Edges are undirected; loops, repeats and edges with a null end are ignored. Nodes without any other edge
    are left out. Each round is written to the shared folder, so the plan does not grow and a lost executor
    costs one round. The number of rounds grows with the logarithm of the largest component's diameter.
    """
    a, b = F.col(src), F.col(dst)
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        state, before = _state(now), state
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

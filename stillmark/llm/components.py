"""Connected components over link tables, and a vectorised union-find for links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable, for every node in ``links`` (columns a, b; any order).

    Every round takes the smallest label among a node's neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    A node with very many links is only a join key with many rows, which the adaptive skew join splits.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both, "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("lower"))
        step = saved(step, "labels-near")
        target = step.select(F.col("node").alias("to_node"), F.col("lower").alias("to_lower"))
        jumped = saved(step.join(target, step.lower == target.to_node, "left").select("node", "label", F.least("lower", F.coalesce("to_lower", "lower")).alias("next")), "labels-jump")
        if jumped.where(F.col("label") != F.col("next")).isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", F.col("next").alias("label"))


class LocalUnion:
    """Union-find over 0..n-1, fed with arrays of links; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

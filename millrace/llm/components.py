"""Connected components of links: of a table's, by alternating large-star and small-star rounds, and of arrays within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written


class Forest:
    """Groups of the numbers 0 to n - 1 that links join, a stripe of links at a time; ``label`` is the least of each group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        u, v = label[u], label[v]
        while (apart := u != v).any():
            u, v = u[apart], v[apart]
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while ((after := label[label]) != label).any():
                label = after
            u, v = label[u], label[v]
        self.label = label


def _least(pairs: DataFrame) -> DataFrame:
    """u and its least neighbour m. Cut, so that the join that follows can split a node with many links."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")))


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; the root is the least node of its component.

    Nulls and links of a node to itself are left out. The number of rounds grows
    with the logarithm of the nodes; each keeps at most as many rows as there are
    links, and groups are reduced before they are shuffled.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    # Written, not checkpointed: checkpoints keep what Catalyst knows of their columns, and after a dozen rounds it is busy with nothing else.
    pairs = written(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("u"), small.alias("v")).distinct(), "pairs")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = _least(large)
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "pairs")
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

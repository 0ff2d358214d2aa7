"""Connected components of a graph held as a table of links.

Rounds of large-star and small-star steps: each round hangs every node under a smaller one that it
can see, until all nodes hang under the smallest of their component. Each round is written to the
shared folder, so plans stay short and a lost executor costs a re-read. Nothing but one row of
counts per round comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node that it reaches.

    ``links`` has two columns of one orderable type, in any order and with repeats; a link of a
    node to itself says nothing.
    """
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    before = _signature(edges)
    while before[0]:
        for step in (_large_star, _small_star):
            least = stored(_least(edges, both=step is _large_star), "least")
            last, edges = edges, stored(step(edges, least), "links")
            discard(last, least)
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """(u, m): the smallest node next to u, or u itself; stored, so that the links of a hub can be split."""
    near = _both(edges) if both else edges
    return near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both(edges).filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    moved = edges.join(least, "u").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
    )
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def spanning(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``size`` nodes' component, for links that one task holds."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new

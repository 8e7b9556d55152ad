"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, write_cut


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between the numbers ``a`` and ``b``: (node, root) of every node
    that is not the smallest of its component, so the links' components are kept
    with fewer rows than nodes. Vectorised: labels take the minimum over links,
    then labels of labels, until nothing changes."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, lab):
            break
        lab = new
        live = lab[u] != lab[v]
        u, v = u[live], v[live]
        if not len(u):
            break
    moved = lab != np.arange(len(nodes))
    return nodes[moved], nodes[lab[moved]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in ``links``; root is the smallest
    node reachable, itself included.

    Each round points all larger neighbours of a node at its smallest neighbour
    (large star), then all smaller neighbours and the node itself at the smallest
    one (small star), until every link points at a root. Rounds are written to the
    shared folder; only one count and one checksum a round come to the driver. A
    node's smallest neighbour is an aggregate with partial sums, and neighbours
    are found by joins that Spark can split, so a node with very many links does
    not meet in one task.
    """
    spark = links.sparkSession
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u != v").distinct())
    e, path = write_cut(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("n")).select(
            "c", F.least("c", "n").alias("m"))
        large = (both.where("v > u").join(least, F.col("u") == F.col("c"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u != v").distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c"))
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))))
        nxt, new_path = write_cut(small.where("u != v").distinct())
        state = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_path(spark, path)
        e, path = nxt, new_path
        if state == before:
            break
        before = state
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))

"""Connected components of a graph given as a table of links, by hooking and contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``, the smallest node reachable, for every node with a link.

    Each round hooks every node to its smallest neighbour, shortens the resulting trees by pointer jumping and
    contracts the links onto the roots. Only nodes that are smaller than all their neighbours stay roots, so at least
    half of the linked nodes go in each round. Nothing is collected; nulls and self-links are ignored.
    """
    links = scratch.save(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    total: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.save(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"), F.lit(True).alias("moved")), "hook")
        while not up.where("moved").isEmpty():
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = scratch.save(up.join(above, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
        to_root = up.select(F.col("u").alias("a"), F.col("p").alias("root"))
        if total is None:
            total = to_root.select(F.col("a").alias("node"), F.col("root").alias("component"))
        else:
            total = scratch.save(
                total.join(to_root, total.component == to_root.a, "left").select("node", F.coalesce("root", "component").alias("component")), "labels"
            )
        links = scratch.save(
            links.join(to_root, links.u == to_root.a).select(F.col("root").alias("u"), "v")
            .join(to_root.withColumnRenamed("root", "to"), F.col("v") == F.col("a")).select("u", F.col("to").alias("v"))
            .where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links",
        )
    if total is None:
        total = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return total


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect the same nodes as links (a, b)."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            touched = np.unique(np.concatenate([a, b]))
            return touched, label[touched]
        label = new

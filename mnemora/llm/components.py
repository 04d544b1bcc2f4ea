"""Connected components of a distributed edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Rounds grow with the logarithm of the longest chain; this many mean a fault.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge to another.

    ``edges`` has long columns ``src`` and ``dst``; self-links, repeats and either direction are fine.
    Each round links all of a node's larger neighbours, then all its smaller ones, to its smallest
    neighbour. It uses minima with partial aggregation and equi-joins only, so a hub's neighbours are
    never gathered. Minima and edges are checkpointed in the shared folder: both sides of a join are
    then plain exchanges, and a hub's edges can be split over tasks. Two sums reach the driver.
    """
    shared_dir(edges.sparkSession)
    link = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        state = link.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return link.select(F.col("a").alias("node"), F.col("b").alias("component")).union(link.select("b", "b").distinct())
        before = state
        both = link.union(link.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.filter("b > a").join(least, both["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).checkpoint()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).checkpoint()
        moved = large.join(small, large["a"] == small["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        link = moved.union(small.select("u", "m")).distinct().checkpoint()
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def merge_labels(root: np.ndarray, r: np.ndarray, s: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """``root`` after joining the components of linked rows: the smallest row spreads until nothing changes."""
    both = np.concatenate([r, s])
    old = root[both]
    label, most = old.copy(), len(root)
    while True:
        a, c = label[: len(r)], label[len(r) :]
        new = np.concatenate([np.minimum(a, np.where(ok, c[None, :], most).min(1)), np.minimum(c, np.where(ok, a[:, None], most).min(0))])
        least = np.arange(most)
        np.minimum.at(least, old, new)
        new = np.minimum(least[old], new)
        if (new == label).all():
            break
        label = new
    to = np.arange(most)
    np.minimum.at(to, old, label)
    return to[root]

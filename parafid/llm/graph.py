"""Connected components of a distributed set of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a long, b long); component is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes: each node
    hands its larger neighbours, then its smaller ones, to the smallest node it
    knows. Rounds grow with the logarithm of the nodes. Each step joins two
    stored tables, so a node with very many links is split over tasks, and a
    lost executor repeats part of one step.

    Links with a null end and links of a node with itself are left out; links
    may repeat, in either direction. No links give no rows.
    """
    store = Store(links.sparkSession, "components")
    now = store.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .filter("a is not null and b is not null and a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        before, n = mark, store.n
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = store.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store.keep(large.filter("a <> b").distinct())
        least = store.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store.keep(small.union(least).distinct())
        store.drop(*range(n, store.n))
        mark = _mark(now)
        if mark == before:
            break
    # every larger node now points at its component's smallest
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label

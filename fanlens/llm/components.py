"""Connected components of links between longs, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.llm.common import durable


def local_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 by the links i[k] - j[k] (and those already in ``label``)."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
    return label


def connected(links: DataFrame, few: int = 0) -> DataFrame:
    """links: u, v (long).  Returns node, root: the smallest node reachable, for each node with a link.

    Every round is one pass of joins and minima with partial aggregation, written
    to the shared folder; a hot centre's links are never gathered in one group.
    Up to ``few`` links (counted first) are worked on by one task without a shuffle."""
    small = few > 0 and links.count() <= few
    one = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    links = one(links)
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = one(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = one(durable(one(edges).distinct()))
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

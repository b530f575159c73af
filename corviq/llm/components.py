"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import materialize, release


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` local nodes over the links ``left[k] - right[k]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _print(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of a column type with an order to (node, component): the smallest node reachable.

    Nodes without a link to another node have no row; links with a null end are ignored. Each round is written to the
    shared folder, so a lost executor costs one round at most; rounds grow with the logarithm of the nodes. A hub with
    very many links meets only joins that adaptive execution can split and aggregates that combine on the map side.
    The result reads the last round's table.
    """
    edges = (
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialize(edges)
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, edges, edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        new = materialize(small, large)
        now = _print(new)
        release(edges, large)
        edges = new
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

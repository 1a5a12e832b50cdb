"""Connected components of a distributed list of links, and names for its nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b); a and b are longs.

    Alternates large-star and small-star steps (Kiveris and others, 2014): each is one aggregation
    and one join over the links, so no component meets in one task, and about the square of the
    logarithm of the largest component's size bounds the steps. Each step's links are written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before it is joined: Spark can split a centre's many links only in a join of plain shuffles.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), name)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), name)
        # At rest every node has one link, to a node that has none to a smaller one.
        ends = edges.groupBy(F.col("a").alias("end")).agg(F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty() and edges.join(ends, F.col("b") == F.col("end"), "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of n places by links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def named(rows: DataFrame, mixed: DataFrame, id_col: str) -> DataFrame:
    """rows with own: whether a row's id names a node, that is isn't one of the ids in mixed, which different contents share."""
    shared = mixed.select(F.col(id_col).alias("__id"), F.lit(False).alias("own"))
    return rows.join(shared, F.col(id_col) == F.col("__id"), "left").drop("__id").withColumn("own", F.coalesce("own", F.lit(True)))


def made_name(*content: str) -> Column:
    """A name made from a node's content: negative, 63 bits of a hash."""
    return F.xxhash64(*content).bitwiseOR(F.lit(-(1 << 63)))

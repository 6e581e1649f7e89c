"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another: root is the
    smallest node of its component.

    A round replaces the links by stars around smaller nodes, each a minimum per
    node (combined before the shuffle) and a join; neighbours are never listed,
    so a node with many links is no large row.  The minima are a table of their own:
    both sides of the join are then plain exchanges, whose skewed partitions Spark splits
    (it cannot where an aggregate lies between).  Each round is a table in the shared
    folder; their number grows with the logarithm of the links' longest chain.
    Null ends and self links count as no link; an empty table gives no rows.
    """
    edges = written(_ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    state = _state(edges)
    for k in count():
        if state[0] == 0:
            break
        edges = written(_small_star(written(_large_star(edges), f"large-{k}")), f"round-{k}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("root"), F.col("u").alias("node"))
    return roots.select("node", "root").union(roots.select("root", "root").distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 8))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return _ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(moved.union(least.select("u", F.col("m").alias("v"))))

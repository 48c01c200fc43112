"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b): the smallest node of its component.

    Alternates the large-star and small-star steps: each node hands the smallest
    node it knows to its neighbours until nothing changes. A star's centre is
    reached by a minimum that is combined before the shuffle, so a node with very
    many links is no hot group. Every round is written to the shared folder.
    """
    links = links.filter(F.col("a") != F.col("b"))
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "nodes")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours link to the smallest neighbour.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        edges = saved(large.filter(F.col("a") != F.col("b")), "links")
        # Small star: a node and its smaller neighbours link to the smallest of these.
        down = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "c")
        joined = edges.join(down, F.col("b") == F.col("c"))
        small = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = small.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = saved(small.distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = edges.select(F.col("b").alias("child"), F.col("a").alias("root"))
    return nodes.join(root, F.col("node") == F.col("child"), "left").select("node", F.coalesce("root", "node").alias("root"))

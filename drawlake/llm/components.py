"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import cut

MOST_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root: every node of a link and the least node of its component.

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones; the number of rounds
    grows with the logarithm of the longest path. Each round is materialised, minima and links apart, so that the join of
    the two starts at an exchange on both sides and adaptive execution can split a node of many links. Self links and
    nulls vanish.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(MOST_ROUNDS):
        print_ = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before:
            break
        before = print_
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct())
        lower = cut(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(lower, F.col("a") == F.col("u")).select(F.col("b").alias("v"), "m").where("v <> m")
        edges = cut(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

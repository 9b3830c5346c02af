"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import Scratch


def _measure(edges: DataFrame) -> tuple:
    """Count and two order-free sums, equal for equal edge sets but for a chance of about 2**-64."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge table of longs; the component is its smallest node.

    Alternates two star contractions (every node's larger neighbours, then its smaller ones, are linked to the
    smallest node that it sees) until the edges no longer change. Each half round is one aggregation, combined
    before its shuffle, and one join; the number of rounds grows with the logarithm of the longest path, not
    with its length. Rounds are written to the shared folder, so lineage stays short. Self-loops make their node
    a component of its own if it has no other edge; null ends are dropped; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    nodes = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    now = scratch.write(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round0")
    before = _measure(now)
    for k in range(1, max_rounds + 1):
        if before[0] == 0:
            break
        # large star: b > a links to the smallest of a and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = scratch.write(small.distinct(), f"round{k}")
        after = _measure(now)
        scratch.drop(f"round{k - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("component", "node").alias("component"))

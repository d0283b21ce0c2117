"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailward.session import stage


def _jump(parents: DataFrame) -> DataFrame:
    """Follow pointers (node to a smaller one) to their ends, doubling the reach each time."""
    while True:
        onward = parents.select(F.col("node").alias("_via"), F.col("root").alias("_to"))
        longer = parents.join(onward, F.col("root") == F.col("_via"), "left")
        nxt = stage(longer.select("node", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "jump")
        parents = nxt.select("node", "root")
        if nxt.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link in ``links`` (a, b): root is the smallest node reachable.

    Each round every root takes the smallest root it is linked with, and pointers are
    followed to their ends; then only links between different roots remain. The rounds are
    logarithmic in the longest chain, and each is a few joins of written tables.
    """
    edges = stage(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        hooked = _jump(stage(pairs.groupBy("node").agg(F.min("root").alias("root")), "hook"))
        onward = hooked.select(F.col("node").alias("_via"), F.col("root").alias("_to"))
        roots = roots.join(onward, F.col("root") == F.col("_via"), "left").select("node", F.coalesce("_to", "root").alias("root"))
        roots = stage(roots, "roots")
        renamed = edges.join(onward, F.col("a") == F.col("_via"), "left").select(F.coalesce("_to", "a").alias("a"), "b")
        renamed = renamed.join(onward, F.col("b") == F.col("_via"), "left").select("a", F.coalesce("_to", "b").alias("b"))
        edges = stage(renamed.where("a <> b").distinct(), "links")
    return roots

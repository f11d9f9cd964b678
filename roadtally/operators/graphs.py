"""Connected parts and chains of links, as joins: no part is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtally.sources.sinks import kept_table


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the nodes of edges (a, b) with the least node that each is connected to.

    In turn every node sends its larger neighbours, then its smaller ones, to the least node that it knows. The number of
    rounds grows with the logarithm of the longest way in a part, and each writes a table of at most as many edges.
    Null ends and edges from a node to itself are left out; no edges give no rows."""
    edges = kept_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = up.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("least"))
        joined = down.join(low, "a")
        new = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(low.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        new = kept_table(new, "edges")
        if new.count() == edges.count() and new.subtract(edges).isEmpty():
            break
        edges = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("part")).union(new.select("b", "b").distinct())


def chains(links: DataFrame) -> DataFrame:
    """(node, head, place): each node of links (a, b) with the first node of its chain and its place in it, from 0.

    A node has at most one link to it and one from it, and links form no ring. Every node points at the one before it; each round
    doubles how far back it points, so a chain of n nodes takes log2(n) rounds of one join."""
    links = kept_table(links.select("a", "b"), "links")
    back = kept_table(links.select(F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).cast("long").alias("place")), "chains")
    while True:
        further = back.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("place").alias("steps"))
        joined = back.join(further, "head", "left")
        new = joined.select("node", F.coalesce("next", "head").alias("head"), (F.col("place") + F.coalesce("steps", F.lit(0))).alias("place"), F.col("next").isNotNull().alias("moved"))
        new = kept_table(new, "chains")
        open_ = not new.where("moved").isEmpty()
        back = new.drop("moved")
        if not open_:
            break
    heads = links.join(links.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("head"), F.lit(0).cast("long").alias("place"))
    return back.unionByName(heads)

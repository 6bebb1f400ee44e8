"""Connected components of a link table, by rounds of star contraction.

Every round points each node at the smallest label among itself and its neighbours (two grouped
minima, combined before the shuffle, so a node with a third of all links is no burden), then
follows pointers.  Links and labels stay distributed; each round is cut off by a reliable checkpoint.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import files_for


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: comparable ids, any direction, repeats allowed) to ``node``, ``component`` (its smallest member).

    Links are contracted: (a, b) becomes (smaller label, larger label) until every remaining link is a
    node's pointer to its component's smallest member."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count = edges.count()
    if not count:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour (or itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        # links only get fewer: a round is written by as many tasks as their number asks for
        new = cut_lineage(moved.select("x.u", "x.v").where("u <> v").distinct().coalesce(files_for(count)))
        # done when every node has one pointer and no node pointed at points on
        state = new.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
        count = state["all"]
        deep = new.select(F.col("v").alias("u")).distinct().join(new, "u", "left_semi")
        edges = new
        if state["n"] == 1 and deep.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

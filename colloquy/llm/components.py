"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a grouped minimum and a join on the node, so the labels of a
component meet no single task and nothing is collected. The minima are written
before the join: it then deals both sides itself, and Spark can split a node with
very many neighbours. Each round is written to the shared folder, which the next
one clears; it ends when a round leaves the edges as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """edges (u, v) with u > v to the same form: each node's neighbours linked to its smallest neighbour."""
    both = edges.select("u", "v") if not large else edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "least")
    joined = both.join(least, F.col("u") == F.col("node"))
    if large:  # the larger neighbours, linked to the smallest of the node and all its neighbours
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node and its smaller neighbours, linked to the smallest of them
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    out = scratch.table(out.filter(F.col("u") > F.col("v")).distinct(), "star")
    scratch.drop(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), as a written table: root is the smallest node reachable. A node's own root may be itself."""
    with Scratch(edges.sparkSession, "components") as scratch:
        now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
        mark = _mark(now)
        for _ in range(most_rounds):
            stars = _star(now, True, scratch)
            scratch.drop(now)
            now = _star(stars, False, scratch)
            scratch.drop(stars)
            seen = _mark(now)
            if seen == mark:
                break
            mark = seen
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        return written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.session import among, forget, stored


def _star(edges: DataFrame, few: bool) -> DataFrame:
    """One large-star and one small-star step on (a, b) with a > b.

    Every neighbour above a node moves to the least neighbour, then every node
    and its lower neighbours move to the least of them. Only minima are
    gathered, so a hub costs one row for each edge and no list. While there are
    `few` edges the minima are broadcast, so that a step shuffles nothing else.
    Equal edges need no step of their own: minima do not count them.
    """
    sent = F.broadcast if few else lambda minima: minima
    above = edges.groupBy("a").agg(F.min("b").alias("m"))
    large = edges.join(sent(above.select(F.col("a").alias("b"), "m")), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(sent(low), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).union(moved if few else moved.distinct())


def connected(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(node, comp) of every node on an edge (a, b), stored; comp is the least node it reaches.

    The steps end when no edge changes, after a number of rounds that grows with
    the logarithm of the longest path. Beyond `most` edges nothing is broadcast.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        last, now = now, stored(_star(now, mark[0] <= most), "stars")
        forget(last)
        before, mark = mark, _mark(now)
    found = stored(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp")), "components")
    forget(now)
    return found


def joined(found: DataFrame, edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The stored components `found` after further stored edges (a, b), as `connected` gives them for all edges together.

    An edge is taken as one between the components of its ends, so that the steps
    run over what is new only. `found` is deleted when it is superseded.
    """
    if edges.isEmpty():
        return found
    between = edges.select("a", "b")
    for end in ("a", "b"):
        root = found.select(F.col("node").alias(end), "comp")
        between = among(between, root, end, "left", most).withColumn(end, F.coalesce("comp", end)).drop("comp")
    apart = edges.filter("a <> b")
    alone = apart.select(F.col("a").alias("node")).union(apart.select(F.col("b").alias("node"))).select("node", F.col("node").alias("comp"))
    over = connected(between, most)
    moved = among(found.unionByName(alone), over.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left", most)
    result = stored(moved.select("node", F.coalesce("to", "comp").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp")), "components")
    forget(over, found)
    return result


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

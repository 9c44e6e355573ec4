"""Connected components of one large graph of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rotagraph.session import discard, written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges``. Loops and
    repeats do not matter; nodes without an edge to another are absent.

    Alternates large-star and small-star rounds (each node hands its larger, then its
    smaller neighbours to the smallest one) until the edges are stars. Every round is
    written to the shared folder, so lineage stays short, and deleted when the next one
    stands; what a skewed join may split must be a plain table, so the least neighbours are
    written too.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "stars")
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # edges (a, b), b < a: the smaller neighbours of a, and a itself, go to the smallest
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        before, now = now, written(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(before)
        discard(least)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = new

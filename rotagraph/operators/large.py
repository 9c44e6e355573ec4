"""One large graph as a frame of edges (a, b): verdicts by component.

Loops and repeats go; then, for planarity and the searches for K3,3 and K4, vertices of
degree 1 are peeled off by joins, as no homeomorph holds them (for the others too); edge
counts decide what they can; what is left is decided component by component in a kernel.
A component is one task: no practical distributed algorithm is known for a single giant
block, so such a block must fit one executor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rotagraph.functions import kernels
from rotagraph.operators.components import connected
from rotagraph.session import written


def peeled(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Edges left when vertices of degree 1 go, again and again, at most ``rounds`` times;
    peeling less is slower later, never wrong."""
    now = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "peel")
    count = now.count()
    for _ in range(rounds):
        ends = now.select(F.col("a").alias("x")).unionByName(now.select(F.col("b").alias("x"))).groupBy("x").count().where("count > 1").select("x")
        kept = now.join(ends.withColumnRenamed("x", "a"), "a", "left_semi").join(ends.withColumnRenamed("x", "b"), "b", "left_semi").select("a", "b")
        now = written(kept, "peel")
        left = now.count()
        if left == count:
            break
        count = left
    return now


def component_verdicts(edges: DataFrame, cmd: str) -> DataFrame:
    """(root, n, m, verdict) of every component that peeling leaves; the whole graph is OK
    iff all of them are. Components that counts decide never reach a kernel."""
    core = peeled(edges)
    found = written(connected(core), "large-components")
    own = core.join(found.withColumnsRenamed({"node": "a"}), "a")
    sizes = found.groupBy("root").agg(F.count("*").alias("n")).join(own.groupBy("root").agg(F.count("*").alias("m")), "root")
    limit = {"p": 3 * F.col("n") - 6, "d": 3 * F.col("n") - 6, "3": 3 * F.col("n") - 5}.get(cmd, 2 * F.col("n") - 3 if cmd in "o4" else None)
    surely_bad = F.lit(False) if limit is None else F.col("m") > limit
    surely_fine = F.col("m") < {"p": 9, "d": 9, "3": 9, "2": 6, "4": 6, "o": 6}[cmd]
    sizes = sizes.withColumn("verdict", F.when(surely_bad, "NONEMBEDDABLE").when(surely_fine, "OK"))
    open_edges = own.join(sizes.where("verdict IS NULL").select("root", "n", "m"), "root")

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        k, local, _ = kernels.relabelled(list(zip(frame["a"], frame["b"], strict=True)))
        bad = kernels.OFFENDS[cmd](k, kernels.simple(local))
        return pd.DataFrame({"root": [frame["root"].iloc[0]], "n": [k], "m": [len(frame)], "verdict": ["NONEMBEDDABLE" if bad else "OK"]})

    decided = open_edges.groupBy("root").applyInPandas(kernel, "root long, n long, m long, verdict string")
    return sizes.where("verdict IS NOT NULL").select("root", "n", "m", "verdict").unionByName(decided)

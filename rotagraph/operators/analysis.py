"""Analyses over decided collections: searches cross-checked by the other tests, tables
with what the cross-check found, differences where counts differ, outputs of one graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.operators import embedding
from rotagraph.schema import NONEMBEDDABLE, OK
from rotagraph.session import written
from rotagraph.sources.graph6 import format_g6, parse_g6

#: Search -> the test whose obstruction may be what the search looks for, and that homeomorph.
OTHER_TEST = {"2": ("o", "K2,3"), "3": ("p", "K3,3"), "4": ("o", "K4")}


def _by_command(k: int):
    return F.create_map(*[F.lit(x) for cmd, other in OTHER_TEST.items() for x in (cmd, other[k])])[F.col("cmd")]


def most_edges(n: str = "n"):
    """Edges of the complete graph whose order is in column ``n``."""
    return F.expr(f"{n} * ({n} - 1) div 2")


def edge_deleted(rows: DataFrame) -> DataFrame:
    """(whole, cmd, g6): for ``rows`` (g6, cmd) every graph that lacks one edge of ``whole``."""

    def run(batches):
        for b in batches:
            out = []
            for line, cmd in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, edges = parse_g6(line)
                out += [(line, cmd, format_g6(n, edges[:k] + edges[k + 1 :])) for k in range(len(edges))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["whole", "cmd", "g6"])

    return rows.select("g6", "cmd").mapInArrow(run, "whole string, cmd string, g6 string")


def cross_checked(lines: DataFrame) -> DataFrame:
    """(g6, cmd, kind, deletions, invalid_ok) of the distinct ``lines`` (g6) that a search for
    K2,3, K3,3 or K4 decides OK. ``kind``: the obstruction that the test for outerplanarity
    (K2,3, K4) or planarity (K3,3) finds; null where it finds none, so nothing can have been
    missed. If it is the homeomorph of the search, the OK was invalid; if it is the other
    one, every edge is deleted in turn, and the OK was invalid if the test then finds the
    search's. Lines that cannot be read have no row."""
    fine = embedding.decide(lines, list(OTHER_TEST)).where(F.col("verdict") == OK).select("g6", "cmd", _by_command(0).alias("test"))
    tested = embedding.decide(lines, ["p", "o"], certificates=True).select("g6", F.col("cmd").alias("test"), F.col("minor_type").alias("kind"))
    found = written(fine.join(tested, ["g6", "test"]), "cross-check")
    deleted = written(edge_deleted(found.where(F.col("kind") != _by_command(1))), "edge-deleted")
    again = embedding.decide(deleted, ["p", "o"], certificates=True).select("g6", F.col("cmd").alias("test"), F.col("minor_type").alias("left"))
    exposed = deleted.withColumn("test", _by_command(0)).join(again, ["g6", "test"])
    by_graph = exposed.groupBy(F.col("whole").alias("g6"), "cmd").agg(F.count("*").alias("deletions"), F.max(F.coalesce(F.col("left") == _by_command(1), F.lit(False))).alias("exposed"))
    both = found.join(by_graph, ["g6", "cmd"], "left")
    invalid = F.coalesce(F.col("kind") == _by_command(1), F.lit(False)) | F.coalesce("exposed", F.lit(False))
    return both.select("g6", "cmd", "kind", F.coalesce("deletions", F.lit(0)).cast("long").alias("deletions"), invalid.alias("invalid_ok"))


def with_invalid(decided: DataFrame, checked: DataFrame) -> DataFrame:
    """(cmd, n, m, num_graphs, num_ok, num_nonembeddable, num_invalid_ok): the count table of
    ``decided`` beside the OKs that ``checked`` holds invalid; null for commands that are
    not searches. Both name graphs by ``g6``, one row a graph and command."""
    bad = checked.where("invalid_ok").select("g6", "cmd", F.lit(1).alias("bad"))
    count = lambda verdict: F.count(F.when(F.col("verdict") == verdict, 1))
    counted = decided.join(bad, ["g6", "cmd"], "left").groupBy("cmd", "n", "m").agg(F.count("*").alias("num_graphs"), count(OK).alias("num_ok"), count(NONEMBEDDABLE).alias("num_nonembeddable"), F.count("bad").alias("bad"))
    return counted.withColumn("num_invalid_ok", F.when(F.col("cmd").isin(list(OTHER_TEST)), F.col("bad"))).drop("bad")


def discrepancy_differences(decided: DataFrame, cells: DataFrame, variant: str = "src") -> DataFrame:
    """(n, m, g6, present, absent): for the orders and sizes in ``cells`` (n, m, ...), where
    variants of a collection disagree, every line that one variant holds and another lacks.
    ``decided`` (variant, n, m, g6). One aggregation by line instead of a join a pair of
    variants; variants are a few names."""
    own = decided.join(F.broadcast(cells.select("n", "m").distinct()), ["n", "m"], "left_semi")
    names = own.agg(F.collect_set(variant).alias("_names"))  # one row
    held = own.groupBy("n", "m", "g6").agg(F.collect_set(variant).alias("_held"))
    pairs = held.join(F.broadcast(names)).withColumn("_lacking", F.array_except("_names", "_held")).where("size(_lacking) > 0")
    return pairs.select("n", "m", "g6", F.explode("_held").alias("present"), "_lacking").select("n", "m", "g6", "present", F.explode("_lacking").alias("absent"))


def outputs(decided: DataFrame, base: int = 0) -> DataFrame:
    """(g6, cmd, verdict, primary, secondary) of graphs decided with certificates. ``primary``:
    the embedding (p, d, o) or the homeomorph found (2, 3, 4) as adjacency list, null where
    there is none. ``secondary``: the obstruction as adjacency list (p, o) or the picture
    of the drawing (d), else null."""

    def listing(rings) -> str:
        return f"N={len(rings)}\n" + "".join(f"{v + base}: {''.join(f'{w + base} ' for w in ring)}{base - 1}\n" for v, ring in enumerate(rings))

    def lists(n: int, edges: list[dict]) -> list[list[int]]:
        near: list[list[int]] = [[] for _ in range(n)]
        for e in edges:
            near[e["u"]].append(e["v"])
            near[e["v"]].append(e["u"])
        return [sorted(x) for x in near]

    def texts(n, cmd, obstruction, rotation, vis_v, vis_e):
        found = None if obstruction is None else listing(lists(n, obstruction))
        drawn = None if rotation is None else listing([r["nbrs"] for r in sorted(rotation, key=lambda r: r["v"])])
        if cmd in OTHER_TEST:
            return found, None
        return drawn, embedding.render(vis_v, vis_e) if vis_v is not None else found if cmd in "po" else None

    def run(batches):
        for b in batches:
            got = [texts(*row) for row in zip(*(b.column(k).to_pylist() for k in (3, 1, 4, 5, 6, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array([x[k] for x in got], pa.string()) for k in range(2))], names=["g6", "cmd", "verdict", "primary", "secondary"])

    rows = decided.select("g6", "cmd", "verdict", "n", "obstruction", "rotation", "vis_v", "vis_e")
    return rows.mapInArrow(run, "g6 string, cmd string, verdict string, primary string, secondary string")

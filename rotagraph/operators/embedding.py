"""Verdicts and certificates of encoded graphs, and facial walks of rotations.

Equal encodings are decided once: the distinct lines go through the kernel in Arrow batches,
and verdicts return by an equi-join. A line is one row, so batches hold thousands of small
graphs. A graph that cannot be read is a row with an error; it stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rotagraph.functions import kernels
from rotagraph.schema import CERTIFICATES, ERROR, NONEMBEDDABLE, OK
from rotagraph.sources.graph6 import parse_g6

#: Commands that callers add: name -> (does a graph offend?, obstruction or None).
_added: dict[str, tuple[Callable, Callable | None]] = {}


def register_command(name: str, offends: Callable, obstruction: Callable | None = None) -> None:
    """Adds a per-graph command: ``offends(n, edges)``, and optionally ``obstruction(n, edges)``."""
    if name in kernels.OFFENDS:
        raise ValueError(f"{name!r} is built in")
    _added[name] = (offends, obstruction)


def remove_command(name: str) -> None:
    _added.pop(name, None)


def _decide(line: str, cmd: str, added: dict) -> dict:
    out = {"g6": line, "cmd": cmd, "verdict": ERROR, "n": None, "m": None, "minor_type": None, "error": None, "obstruction": None, "rotation": None, "vis_v": None, "vis_e": None}
    try:
        n, edges = parse_g6(line)
    except ValueError as e:
        return out | {"error": str(e)}
    offends, isolate = added[cmd] if cmd in added else (kernels.OFFENDS[cmd], None)
    bad = offends(n, edges)
    out |= {"n": n, "m": len(edges), "verdict": NONEMBEDDABLE if bad else OK}
    pair = lambda e: {"u": min(e), "v": max(e)}
    if bad:
        if cmd in kernels.OFFENDS or isolate:
            got = isolate(n, edges) if isolate else kernels.obstruction(n, edges, cmd)
            out |= {"obstruction": [pair(e) for e in got], "minor_type": kernels.kind_of(got)}
        return out
    if cmd in "pdo":
        rings = kernels.outerplanar_rotation(n, edges) if cmd == "o" else kernels.planar_rotation(n, edges)
        out["rotation"] = [{"v": v, "nbrs": ring} for v, ring in enumerate(rings)]
    if cmd == "d":
        vertices, lines = kernels.visibility(n, edges, rings)
        out["vis_v"] = [dict(zip(("v", "pos", "start", "end"), x, strict=True)) for x in vertices]
        out["vis_e"] = [dict(zip(("u", "v", "pos", "start", "end"), x, strict=True)) for x in lines]
    return out


def decide(lines: DataFrame, cmds: str | list[str], certificates: bool = False) -> DataFrame:
    """(g6, cmd, n, m, verdict, minor_type, error[, CERTIFICATES]) of distinct ``lines`` (g6)."""
    return decide_rows(lines.select("g6").distinct(), cmds, certificates)


def decide_rows(lines: DataFrame, cmds: str | list[str], certificates: bool = False) -> DataFrame:
    """The same for every row of ``lines``, repeats too."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    unknown = [c for c in cmds if c not in kernels.OFFENDS and c not in _added]
    if unknown:
        raise ValueError(f"unknown commands: {unknown}")
    schema = StructType.fromDDL("g6 string, cmd string, n int, m int, verdict string, minor_type string, error string" + (f", {CERTIFICATES}" if certificates else ""))
    arrow, names, added = to_arrow_schema(schema), list(cmds), dict(_added)

    def plain(texts: list) -> dict:
        """Columns of verdicts alone, without a row's dictionary."""
        out = {f.name: [] for f in arrow}
        for x in texts:
            try:
                n, edges = parse_g6(x or "")
                got = [(n, len(edges), NONEMBEDDABLE if (added[c][0] if c in added else kernels.OFFENDS[c])(n, edges) else OK, None) for c in names]
            except ValueError as e:
                got = [(None, None, ERROR, str(e))] * len(names)
            out["g6"] += [x or ""] * len(names)
            out["cmd"] += names
            for k, column in enumerate(("n", "m", "verdict", "error")):
                out[column] += [g[k] for g in got]
        return out | {"minor_type": [None] * len(out["g6"])}

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 1000):
                part = texts[lo : lo + 1000]
                if not certificates:
                    columns = plain(part)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
                    continue
                rows = [_decide(x or "", c, added) for x in part for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in arrow], schema=arrow)

    return lines.select("g6").mapInArrow(run, schema)


def verdicts(graphs: DataFrame, cmds: str | list[str], certificates: bool = False) -> DataFrame:
    """``graphs`` (graph_id, g6, ...) with their verdicts. Columns n and m are the verdict's."""
    got = decide(graphs, cmds, certificates)
    return graphs.drop("n", "m").join(got, "g6")


def arcs_of(decided: DataFrame, key: str = "g6") -> DataFrame:
    """(key, src, dst, pos) of the rotations."""
    rings = decided.where("rotation IS NOT NULL").select(key, F.explode("rotation").alias("r"))
    return rings.select(key, F.col("r.v").alias("src"), F.posexplode("r.nbrs").alias("pos", "dst"))


def face_successors(arcs: DataFrame, key: str = "g6") -> DataFrame:
    """``arcs`` with ``after``: the arc (u, v) is followed by (v, after), where after comes
    behind u in v's ring. One window over rings and one equi-join with the twins."""
    ring = Window.partitionBy(key, "src").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = arcs.withColumn("after", F.coalesce(F.lead("dst").over(ring), F.first("dst").over(whole)))
    twins = turned.select(key, F.col("src").alias("dst"), F.col("dst").alias("src"), "after")
    return arcs.join(twins, [key, "src", "dst"])


def face_labels(arcs: DataFrame, key: str = "g6") -> DataFrame:
    """(key, src, dst, face): arcs labelled by the least arc of their facial walk, found by
    pointer doubling; arcs are written as src * 2^31 + dst. As many rounds as the longest
    walk has binary digits, which no more than one per arc of a graph bounds."""
    from rotagraph.session import written

    code = lambda a, b: F.shiftleft(F.col(a).cast("long"), 31) + F.col(b)
    now = face_successors(arcs, key).select(key, code("src", "dst").alias("arc"), code("dst", "after").alias("to"), code("src", "dst").alias("face"))
    now = written(now, "faces")
    longest = now.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        ahead = now.select(key, F.col("arc").alias("to"), F.col("to").alias("further"), F.col("face").alias("theirs"))
        now = written(now.join(ahead, [key, "to"]).select(key, "arc", F.col("further").alias("to"), F.least("face", "theirs").alias("face")), "faces")
    return now.select(key, F.shiftright("arc", 31).cast("int").alias("src"), F.col("arc").bitwiseAND((1 << 31) - 1).cast("int").alias("dst"), "face")


def face_counts(arcs: DataFrame, key: str = "g6") -> DataFrame:
    """(key, walks): facial walks of each rotation."""
    return face_labels(arcs, key).groupBy(key).agg(F.count_distinct("face").alias("walks"))


def component_counts(decided: DataFrame) -> DataFrame:
    """(g6, components, edge_components): of small graphs, from their lines."""

    def run(batches):
        for b in batches:
            out = []
            for line in b.column(0).to_pylist():
                n, edges = parse_g6(line)
                parts = kernels._components(n, edges)
                out.append((len(parts), sum(len(p) > 1 for p in parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["g6", "components", "edge_components"])

    return decided.select("g6").distinct().mapInArrow(run, "g6 string, components long, edge_components long")


def faces_by_euler(decided: DataFrame) -> DataFrame:
    """(g6, faces): faces of each embedding, one outer face shared by all components. Facial
    walks count an outer face per component with edges; a graph without edges has one."""
    counts = face_counts(arcs_of(decided))
    both = component_counts(decided.where("rotation IS NOT NULL")).join(counts, "g6", "left")
    return both.select("g6", (F.coalesce("walks", F.lit(0)) - F.col("edge_components") + 1).alias("faces"), "components")


def depth_first(graphs: DataFrame) -> DataFrame:
    """(graph_id, v, parent, number, least_ancestor, lowpoint) of every vertex of ``graphs``
    (graph_id, g6); numbers count from 0 in visiting order, roots have no parent."""
    return _per_graph(graphs, kernels.depth_first, "v int, parent int, number int, least_ancestor int, lowpoint int")


def _per_graph(graphs: DataFrame, f, schema: str) -> DataFrame:
    """(graph_id, ...) rows of ``f(n, edges)`` for ``graphs`` (graph_id, g6)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(f"graph_id long, {schema}"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = [(i, *x) for i, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in f(*parse_g6(line))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=x.type) for k, x in enumerate(arrow)], schema=arrow)

    return graphs.select(F.col("graph_id").cast("long"), "g6").mapInArrow(run, f"graph_id long, {schema}")


def edge_classes(graphs: DataFrame) -> DataFrame:
    """(graph_id, u, v, class) of every edge after a depth-first search: ``tree`` edges lead
    from parent to child, ``back`` edges from ancestor to descendant."""
    return _per_graph(graphs, kernels.edge_classes, "u int, v int, class string")


def blocks(graphs: DataFrame) -> DataFrame:
    """(graph_id, vertices, edges) of every biconnected component, its vertices ascending."""

    def rows(n: int, edges: list):
        return [(sorted({x for e in b for x in e}), len(b)) for b in kernels.blocks(n, edges)]

    return _per_graph(graphs, rows, "vertices array<int>, edges int")


def render(vis_v: list, vis_e: list) -> str:
    """A picture of a drawing, two lines a row and a column an edge: ``-`` vertices with
    their labels, ``|`` edges."""
    n, m = len(vis_v), max(1, len(vis_e))
    picture = [[" "] * m for _ in range(2 * n)]
    for x in vis_e:
        for y in range(2 * x["start"], 2 * x["end"] + 1):
            picture[y][x["pos"]] = "|"
    for x in vis_v:
        for c in range(x["start"], x["end"] + 1):
            picture[2 * x["pos"]][c] = "-"
        label, middle = str(x["v"]), (x["start"] + x["end"]) // 2
        lo = max(0, min(middle - (len(label) - 1) // 2, m - len(label)))
        picture[2 * x["pos"]][lo : lo + len(label)] = label
    return "\n".join("".join(row) for row in picture) + "\n"


def rendered(decided: DataFrame) -> DataFrame:
    """(g6, picture) of decided drawings."""

    def run(batches):
        for b in batches:
            pictures = [render(v, e) for v, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pictures)], names=["g6", "picture"])

    return decided.where("vis_v IS NOT NULL").select("g6", "vis_v", "vis_e").mapInArrow(run, "g6 string, picture string")


def face_list(labels: DataFrame, key: str = "g6") -> DataFrame:
    """(key, face, arcs): the facial walks as lists of (src, dst), unordered along the walk."""
    return labels.groupBy(key, "face").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("arcs"))

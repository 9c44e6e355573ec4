"""Sections and lists that go with graph texts: drawings, faces, plain edge lists, and the
result lines of batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.functions import kernels

OPEN, CLOSE = "<DrawPlanar>", "</DrawPlanar>"


def drawing_sections(decided: DataFrame, base: int = 0) -> DataFrame:
    """(g6, section): the drawing of a decided graph, a line per vertex and two per edge,
    one for each of its records, numbered from 2 n on."""
    line = lambda k, x: F.concat(k.cast("string"), F.lit(": "), F.concat_ws(" ", x["pos"], x["start"], x["end"]), F.lit("\n"))
    vertices = F.transform(F.sort_array("vis_v"), lambda x: line(x["v"] + base, x))
    edges = F.flatten(F.transform(F.sort_array("vis_e"), lambda x, i: F.array(line(2 * F.col("n") + 2 * i, x), line(2 * F.col("n") + 2 * i + 1, x))))
    body = F.concat(F.array_join(vertices, ""), F.array_join(edges, ""))
    return decided.where("vis_v IS NOT NULL").select("g6", F.concat(F.lit(OPEN + "\n"), body, F.lit(CLOSE + "\n")).alias("section"))


def parse_drawings(df: DataFrame, section: str = "section") -> DataFrame:
    """``df`` with ``places``: (key, pos, start, end) of every line of a drawing section; null
    where there is none."""
    inner = F.regexp_extract(section, f"{OPEN}([\\s\\S]*?){CLOSE}", 1)
    rows = F.filter(F.split(inner, "\n"), lambda x: x.rlike(r"^\s*\d+:(\s+-?\d+){3}\s*$"))
    number = lambda x, i: F.regexp_extract(x, r"^\s*(\d+):\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)", i).cast("int")
    places = F.transform(rows, lambda x: F.struct(number(x, 1).alias("key"), number(x, 2).alias("pos"), number(x, 3).alias("start"), number(x, 4).alias("end")))
    return df.withColumn("places", F.when(F.col(section).contains(OPEN), places))


def face_texts(decided: DataFrame, base: int = 0) -> DataFrame:
    """(g6, text): for every component with edges ``Component_<k>: |`` and a line per face,
    a closed walk of vertices."""

    def text(rotation: list) -> str:
        rings = [r["nbrs"] for r in sorted(rotation, key=lambda r: r["v"])]
        edges = [(u, v) for u, ring in enumerate(rings) for v in ring if u < v]
        part = {v: k for k, p in enumerate(sorted(map(sorted, kernels._components(len(rings), edges)))) for v in p}
        walks: dict[int, list[str]] = {}
        for walk in kernels.faces(rings):
            walks.setdefault(part[walk[0][0]], []).append(" ".join(str(v + base) for v in [walk[0][0], *(b for _, b in walk)]))
        return "".join(f"Component_{i}: |\n" + "".join(f"  {w}\n" for w in walks[k]) for i, k in enumerate(sorted(walks), 1))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(r) for r in b.column(1).to_pylist()], pa.string())], names=["g6", "text"])

    return decided.where("rotation IS NOT NULL").select("g6", "rotation").mapInArrow(run, "g6 string, text string")


def edge_list_texts(edges: DataFrame, id_col: str = "graph_id") -> DataFrame:
    """(id, text): ``u v`` a line from 1 on, ended by ``0 0``."""
    rows = edges.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("e"))
    lines = F.transform("e", lambda x: F.concat((x["u"] + 1).cast("string"), F.lit(" "), (x["v"] + 1).cast("string"), F.lit("\n")))
    return rows.select(id_col, F.concat(F.array_join(lines, ""), F.lit("0 0\n")).alias("text"))


def batch_lines(stats: DataFrame, name: str) -> DataFrame:
    """(cmd, text): the result of a batch as its two lines."""
    head = F.concat(F.lit(f'FILENAME="{name}" DURATION="'), F.format_string("%.3f", F.coalesce(F.col("duration"), F.lit(0.0)) if "duration" in stats.columns else F.lit(0.0)), F.lit('"\n'))
    return stats.select("cmd", F.concat(head, F.lit("-"), "cmd", F.lit(" "), F.concat_ws(" ", "num_graphs", "num_ok", "num_nonembeddable", "error_flag"), F.lit("\n")).alias("text"))


_RESULT = r'FILENAME="([^"]*)"\s+DURATION="([\d.]+)"\s*\n-(\w)\s+(\d+)\s+(\d+)\s+(\d+)\s+(SUCCESS|ERROR)'


def parse_batch_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(src, duration, cmd, num_graphs, num_ok, num_nonembeddable, error_flag, n, m); order
    and edges are read from names like ``n8.m12.g6``. Other texts give no row."""
    part = lambda i: F.regexp_extract(text, _RESULT, i)
    found = df.where(F.col(text).rlike(_RESULT)).select(part(1).alias("src"), part(2).cast("double").alias("duration"), part(3).alias("cmd"), *(part(k).cast("long").alias(c) for k, c in ((4, "num_graphs"), (5, "num_ok"), (6, "num_nonembeddable"))), part(7).alias("error_flag"))
    number = lambda p: F.try_to_number(F.nullif(F.regexp_extract("src", p, 1), F.lit("")), F.lit("999999")).cast("int")
    return found.withColumns({"n": number(r"(?:^|/)n(\d+)\."), "m": number(r"\.m(\d+)")})


def parse_range(text: str) -> list[int]:
    """``5,7-9`` -> 5, 7, 8, 9."""
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m or m[2] and int(m[2]) < int(m[1]):
            raise ValueError(f"not a range: {part!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)

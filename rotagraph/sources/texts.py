"""Other text forms of one graph: adjacency list, adjacency matrix, LEDA (read), GraphML
(write), and the sniffing of a text's form. Texts are parsed one per row in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rotagraph.sources.graph6 import parse_g6, without_digraphs
from rotagraph.sources.sections import parse_drawings

PARSED = "n int, base int, directed boolean, arcs array<struct<u:int,v:int,dir:string>>, extra string, error string"


def form_of(text: str) -> str:
    """leda, adjlist, adjmatrix or g6, by the first line."""
    first = text.lstrip("\n").split("\n", 1)[0]
    if first.startswith("LEDA.GRAPH"):
        return "leda"
    if first.startswith("N="):
        return "adjlist"
    return "adjmatrix" if first[:1].isdigit() else "g6"


def parse_adjlist(text: str) -> dict:
    """``N=<n>``, then ``v: w w ... end`` for ascending v; the first label is the base, 0 or
    1, and the end mark -1 or 0. An edge listed from both ends is undirected, else directed
    from the listing end. What follows the lists is extra."""
    head = re.match(r"\s*N=\s*(\d+)", text)
    if not head or int(head[1]) < 1:
        raise ValueError("no order")
    n, at, rows, base = int(head[1]), head.end(), [], None
    for k in range(n):
        m = re.compile(r"\s*(-?\d+)\s*:").match(text, at)
        if not m:
            raise ValueError(f"the list of vertex {k} is missing")
        label = int(m[1])
        base = label if base is None else base
        if base not in (0, 1) or label != base + k:
            raise ValueError("labels are not ascending from 0 or 1")
        at, row, mark = m.end(), [], base - 1
        while True:
            m = re.compile(r"\s*(-?\d+)").match(text, at)
            if not m:
                raise ValueError("a list has no end mark")
            at = m.end()
            if int(m[1]) == mark:
                break
            w = int(m[1]) - base
            if not 0 <= w < n:
                raise ValueError("a neighbour is out of range")
            if w == k:
                raise ValueError("a loop")
            row.append(w)
        rows.append(row)
    listed = {(u, w) for u, row in enumerate(rows) for w in row}
    arcs = [(u, w, "UND" if (w, u) in listed else "OUT") for u, w in sorted(listed) if u < w or (w, u) not in listed]
    return {"n": n, "base": base, "arcs": arcs, "extra": text[at:].strip() or None}


def parse_adjmatrix(text: str) -> dict:
    """n, then row u: the entries (u, v) for v > u, zeros and ones."""
    head = re.match(r"\s*(\d+)", text)
    n = int(head[1])
    if n < 1:
        raise ValueError("no order")
    body = re.sub(r"\s", "", text[head.end() :])
    size = n * (n - 1) // 2
    bits = body[:size]
    if len(bits) < size or set(bits) - {"0", "1"}:
        raise ValueError("the matrix is cut off or holds other digits than 0 and 1")
    it = iter(bits)
    return {"n": n, "base": 0, "arcs": [(u, v, "UND") for u in range(n) for v in range(u + 1, n) if next(it) == "1"], "extra": body[size:] or None}


def parse_leda(text: str) -> dict:
    """Header, types, direction -2, n, n node lines, m, m edge lines; loops and repeats go."""
    lines = [x.strip() for x in text.split("\n") if x.strip() and not x.startswith("#")]
    at = next((i for i, x in enumerate(lines) if re.fullmatch(r"-[12]", x)), None)
    if at is None or lines[at] != "-2":
        raise ValueError("only undirected graphs")
    n = int(lines[at + 1])
    if n < 1:
        raise ValueError("no order")
    m = int(lines[at + 2 + n])
    pairs = set()
    for x in lines[at + 3 + n : at + 3 + n + m]:
        u, v = (int(y) - 1 for y in x.split()[:2])
        if not (0 <= u < n and 0 <= v < n):
            raise ValueError("a vertex is out of range")
        if u != v:
            pairs.add((min(u, v), max(u, v)))
    if len(lines) < at + 3 + n + m:
        raise ValueError("edges are missing")
    return {"n": n, "base": 1, "arcs": [(u, v, "UND") for u, v in sorted(pairs)], "extra": None}


def parse_graph(text: str) -> dict:
    """Any of the forms; ``error`` says what is wrong, and the rest is then empty."""
    out = {"n": None, "base": None, "directed": None, "arcs": None, "extra": None, "error": None}
    try:
        form = form_of(text)
        if form == "g6":
            n, edges = parse_g6(text.strip().split("\n")[0])
            got = {"n": n, "base": 0, "arcs": [(u, v, "UND") for u, v in edges]}
        else:
            got = {"leda": parse_leda, "adjlist": parse_adjlist, "adjmatrix": parse_adjmatrix}[form](text)
        out |= got | {"directed": any(d == "OUT" for _, _, d in got["arcs"])}
    except (ValueError, IndexError, TypeError) as e:
        out["error"] = str(e)
    return out


def parse_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with PARSED; one bad text is a row with an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(PARSED).fields)
    arrow = to_arrow_schema(schema)
    fields = [f.name for f in StructType.fromDDL(PARSED)]

    def run(batches):
        for b in batches:
            got = [parse_graph(x or "") for x in b.column(len(kept)).to_pylist()]
            for g in got:
                g["arcs"] = None if g["arcs"] is None else [{"u": u, "v": v, "dir": d} for u, v, d in g["arcs"]]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(len(kept))), *(pa.array([g[f] for g in got], type=arrow.field(len(kept) + i).type) for i, f in enumerate(fields))], schema=arrow)

    return df.select(*kept, text).mapInArrow(run, schema)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(src, PARSED) of files that hold one graph each, in any form."""
    return parse_texts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src"), F.col("value").alias("text")))


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """The same with ``places``: (key, pos, start, end) of the drawing section behind the graph; null without one."""
    return parse_drawings(read_graphs(spark, path), "extra")


def adjacency_texts(graphs: DataFrame, arcs: DataFrame, base: int = 0, id_col: str = "graph_id") -> DataFrame:
    """(id, text): adjacency lists. ``arcs`` (id, src, dst[, pos]): listed in the order of
    ``pos`` where there is one, else of ``dst``."""
    key = "pos" if "pos" in arcs.columns else "dst"
    rows = arcs.groupBy(id_col, "src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), "dst"))), lambda x: (x["dst"] + base).cast("string")), " ").alias("own"))
    every = graphs.select(id_col, "n", F.explode(F.expr("sequence(0, n - 1)")).alias("src")).join(rows, [id_col, "src"], "left")
    line = F.concat((F.col("src") + base).cast("string"), F.lit(": "), F.coalesce(F.concat("own", F.lit(" ")), F.lit("")), F.lit(str(base - 1)), F.lit("\n"))
    lines = every.groupBy(id_col, "n").agg(F.sort_array(F.collect_list(F.struct("src", line.alias("line")))).alias("lines"))
    return lines.select(id_col, F.concat(F.lit("N="), "n", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("text"))


def matrix_texts(graphs: DataFrame, edges: DataFrame, id_col: str = "graph_id") -> DataFrame:
    """(id, text): upper-triangular rows of undirected graphs, with leading blanks; null for digraphs."""
    sets = edges.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "u", "v"), F.lit("1")))).alias("on"))
    both = graphs.select(id_col, "n").join(sets, id_col, "left").withColumn("on", F.coalesce("on", F.create_map().cast("map<string,string>")))
    row = lambda u: F.concat(F.repeat(F.lit(" "), u + 1), F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: F.when(v > u, F.coalesce(F.try_element_at("on", F.concat_ws("-", u, v)), F.lit("0")))), lambda x: x.isNotNull()), ""), F.lit("\n"))
    out = both.select(id_col, F.concat(F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), row), "")).alias("text"))
    return without_digraphs(out, edges, "text", id_col)


def graphml_texts(graphs: DataFrame, arcs: DataFrame, id_col: str = "graph_id") -> DataFrame:
    """(id, text): GraphML of ``arcs`` (id, u, v, dir); directed edges say so one by one."""
    edge = F.concat(F.lit('  <edge source="n'), "u", F.lit('" target="n'), "v", F.lit('"'), F.when(F.col("dir") == "OUT", F.lit(' directed="true"')).otherwise(""), F.lit("/>\n"))
    body = arcs.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "v", edge.alias("x")))), lambda x: x["x"]), "").alias("edges"))
    nodes = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: F.concat(F.lit('  <node id="n'), v.cast("string"), F.lit('"/>\n'))), "")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n <graph id="G" edgedefault="undirected">\n'
    return graphs.select(id_col, "n").join(body, id_col, "left").select(id_col, F.concat(F.lit(head), nodes, F.coalesce("edges", F.lit("")), F.lit(" </graph>\n</graphml>\n")).alias("text"))

"""Degrees, directions, neighbourhoods and structural changes of collections of graphs.

Every function maps frames keyed by ``graph_id`` to frames; nothing is changed in place, so
undoing a change is keeping the frame before it. ``edges``: (graph_id, u, v) with u < v;
``arcs``: (graph_id, src, dst) of a digraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ID = "graph_id"


def undirected(arcs: DataFrame) -> DataFrame:
    """The distinct edges under ``arcs``; loops go."""
    return arcs.where("src != dst").select(ID, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst) from both ends, without a second scan of ``edges``."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return edges.select(ID, ends.alias("x")).select(ID, "x.src", "x.dst")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(ID, F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def direction_classes(arcs: DataFrame) -> DataFrame:
    """(graph_id, u, v, dir): UND where arcs run both ways (u < v), else OUT from u to v.
    One aggregation over unordered pairs instead of a self-join."""
    forth = (F.col("src") < F.col("dst")).cast("int")
    pairs = arcs.where("src != dst").groupBy(ID, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(forth).alias("forth"), F.max(1 - forth).alias("back"))
    flip = (F.col("forth") == 0) & (F.col("back") == 1)
    return pairs.select(ID, F.when(flip, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("v"), F.when((F.col("forth") == 1) & (F.col("back") == 1), "UND").otherwise("OUT").alias("dir"))


def in_out_degrees(classes: DataFrame) -> DataFrame:
    """(graph_id, v, in_degree, out_degree) of direction classes; undirected edges count in both."""
    und = (F.col("dir") == "UND").cast("int")
    ends = F.array(F.struct(F.col("u").alias("v"), und.alias("i"), F.lit(1).alias("o")), F.struct(F.col("v").alias("v"), F.lit(1).alias("i"), und.alias("o")))
    return classes.select(ID, F.explode(ends).alias("x")).groupBy(ID, F.col("x.v").alias("v")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy(ID, "degree").agg(F.count("*").alias("vertices"))


def transposed(arcs: DataFrame) -> DataFrame:
    """Every directed arc reversed; UND rows of direction classes stay."""
    if "dir" in arcs.columns:
        turn = F.col("dir") != "UND"
        return arcs.withColumns({"u": F.when(turn, F.col("v")).otherwise(F.col("u")), "v": F.when(turn, F.col("u")).otherwise(F.col("v"))})
    return arcs.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def without_directions(classes: DataFrame) -> DataFrame:
    return classes.select(ID, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit("UND").alias("dir"))


def are_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (graph_id, u, v) with ``is_neighbor``, in any direction."""
    known = edges.select(ID, "u", "v", F.lit(True).alias("_hit"))
    both = pairs.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
    joined = both.join(known.withColumnsRenamed({"u": "_a", "v": "_b"}), [ID, "_a", "_b"], "left")
    return joined.select(*pairs.columns, F.coalesce("_hit", F.lit(False)).alias("is_neighbor"))


def numbered(edges: DataFrame) -> DataFrame:
    """``edges`` with ``eid``: their places, from 0, in each graph's ascending order."""
    return edges.withColumn("eid", F.row_number().over(Window.partitionBy(ID).orderBy("u", "v")) - 1)


def are_neighbours_directed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (graph_id, u, v) with ``is_neighbor``: an undirected edge, or one from u to v."""
    return find_edges(pairs, classes, directed=True).withColumn("is_neighbor", F.col("eid").isNotNull()).drop("eid")


def find_edges(pairs: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """``pairs`` (graph_id, u, v) with ``eid``: the number of the edge between them, null
    without one. ``directed``: ``edges`` are direction classes, and edges out of v don't count."""
    known = numbered(edges) if "eid" not in edges.columns else edges
    forth = F.struct(F.col("u").alias("a"), F.col("v").alias("b"))
    back = F.struct(F.col("v").alias("a"), F.col("u").alias("b"))
    both = F.when(F.col("dir") == "UND", F.array(forth, back)).otherwise(F.array(forth)) if directed else F.array(forth, back)
    ends = known.select(ID, "eid", F.explode(both).alias("x")).select(ID, F.col("x.a").alias("u"), F.col("x.b").alias("v"), "eid")
    return pairs.join(ends, [ID, "u", "v"], "left")


def equal_graphs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(graph_id, equal) of the graphs with an edge in either frame: whether their edges agree.
    One aggregation over tagged edges instead of a join."""
    tagged = left.select(ID, "u", "v", F.lit(1).alias("s")).unionByName(right.select(ID, "u", "v", F.lit(2).alias("s")))
    edges = tagged.groupBy(ID, "u", "v").agg(F.sum_distinct("s").alias("s"))
    return edges.groupBy(ID).agg((F.min("s") == 3).alias("equal"))


def maximum_degree(edges: DataFrame) -> DataFrame:
    """(graph_id, max_degree) of graphs with an edge."""
    return degrees(edges).groupBy(ID).agg(F.max("degree").alias("max_degree"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, common) of every two vertices u < v with a common neighbour: pairs
    meet within the sorted neighbour list of their middle, as arrays, not by a self-join."""
    lists = both_ways(edges).groupBy(ID, "src").agg(F.sort_array(F.collect_list("dst")).alias("near"))
    pairs = F.flatten(F.transform("near", lambda x, i: F.transform(F.slice("near", i + 2, F.size("near")), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    return lists.select(ID, F.explode(pairs).alias("p")).groupBy(ID, F.col("p.u").alias("u"), F.col("p.v").alias("v")).agg(F.count("*").alias("common"))


def identified(edges: DataFrame, keep: Column, gone: Column) -> DataFrame:
    """Vertex ``gone`` becomes ``keep``; the edge between them and repeats go. Contracting an
    edge is identifying its ends."""
    name = lambda x: F.when(F.col(x) == gone, keep).otherwise(F.col(x))
    return undirected(edges.select(ID, name("u").alias("src"), name("v").alias("dst")))


def without_vertex(edges: DataFrame, vertex: Column) -> DataFrame:
    return edges.where((F.col("u") != vertex) & (F.col("v") != vertex))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(ID, "u", "v"), [ID, "u", "v"], "left_anti")


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges added; those there already and loops are not added again."""
    new = more.select(ID, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v")
    return edges.select(ID, "u", "v").unionByName(new).distinct()


def insert_arc(arcs: DataFrame, new: DataFrame) -> DataFrame:
    """``arcs`` (graph_id, src, dst, pos) with ``new`` (graph_id, src, dst, after): behind the
    place ``after``; null: in front. Places are numbered anew from 0."""
    old = arcs.select(ID, "src", "dst", F.col("pos").cast("double").alias("k"))
    put = new.select(ID, "src", "dst", (F.coalesce("after", F.lit(-1)) + 0.5).alias("k"))
    ring = Window.partitionBy(ID, "src").orderBy("k", "dst")
    return old.unionByName(put).withColumn("pos", F.row_number().over(ring) - 1).drop("k")


def only_edges(edges: DataFrame, marked: DataFrame) -> DataFrame:
    return edges.join(marked.select(ID, "u", "v"), [ID, "u", "v"], "left_semi")


def relabelled(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Vertices renamed by ``numbers`` (graph_id, v, number); with a depth-first numbering
    this sorts vertices, with its inverse it undoes that."""
    a = numbers.select(ID, F.col("v").alias("u"), F.col("number").alias("_a"))
    b = numbers.select(ID, "v", F.col("number").alias("_b"))
    both = edges.join(a, [ID, "u"]).join(b, [ID, "v"])
    return both.select(ID, F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))


def sizes(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, m)."""
    m = edges.groupBy(ID).agg(F.count("*").cast("int").alias("m"))
    return graphs.select(ID, "n").join(m, ID, "left").select(ID, "n", F.coalesce("m", F.lit(0)).alias("m"))


def euler_filter(sizes: DataFrame) -> DataFrame:
    """``sizes`` with what edge counts alone decide for planarity: no, yes or null."""
    no = (F.col("n") > 2) & (F.col("m") > 3 * F.col("n") - 6)
    return sizes.withColumn("planar_by_count", F.when(no, "no").when((F.col("n") < 5) | (F.col("m") < 9), "yes"))

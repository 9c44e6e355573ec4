"""The queries of the graph engine and the SQL that states their results.

Verdicts of five-vertex graphs have rules in plain SQL: planar iff fewer than ten edges;
K2,3-free iff no two vertices have three common neighbours; K4-free iff no four vertices
have six edges, or five with the missing two both adjacent to the fifth; outerplanar iff
both; a K3,3 homeomorph needs six. A bipartite graph whose smaller side has three vertices
has a K3,3 homeomorph, and is nonplanar, iff three of the others are adjacent to all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rotagraph.functions import kernels
from rotagraph.operators import analysis, collections, components, embedding, relational, verify
from rotagraph.plans import derive
from rotagraph.session import table
from rotagraph.sources import graph6, sections, texts

ID = "graph_id"

_TYPES = "types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))"
_PART = {"user": "0", "day": "dayofyear(ts)", "5day": "CAST(floor((dayofyear(ts) - 1) / 5) AS BIGINT)"}


def _arcs_sql(bucket: str = "user") -> str:
    return f"""{_TYPES}, typed AS (SELECT user_id * 1000 + {_PART[bucket]} AS graph_id, ts, event_id, number FROM events JOIN types USING (event_type)),
 arcs AS (SELECT graph_id, src, dst FROM (SELECT graph_id, number AS src, lead(number) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS dst FROM typed) WHERE dst IS NOT NULL),
 edges AS (SELECT DISTINCT graph_id, least(src, dst) AS u, greatest(src, dst) AS v FROM arcs WHERE src <> dst),
 ends AS (SELECT graph_id, u AS src, v AS dst FROM edges UNION ALL SELECT graph_id, v, u FROM edges),
 graphs AS (SELECT graph_id, CAST(count(*) AS INTEGER) AS m FROM edges GROUP BY 1)"""


#: g6 of five-vertex graphs: ten bits in two characters.
_LINES = """lines AS (SELECT graph_id, m, 'D' || chr(CAST(63 + a AS INTEGER)) || chr(CAST(63 + b AS INTEGER)) AS g6 FROM (SELECT graph_id, count(*)::INTEGER AS m,
 sum(CASE WHEN k < 6 THEN 1 << (5 - k) ELSE 0 END) AS a, sum(CASE WHEN k >= 6 THEN 1 << (11 - k) ELSE 0 END) AS b
 FROM (SELECT graph_id, v * (v - 1) // 2 + u AS k FROM edges) GROUP BY graph_id))"""

_RULES = """near AS (SELECT graph_id, src, list(dst) AS ns FROM ends GROUP BY 1, 2),
 k23 AS (SELECT DISTINCT graph_id FROM (SELECT a.graph_id, a.src AS s, b.src AS t, count(*) AS c FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.dst = b.dst AND a.src < b.src GROUP BY 1, 2, 3) WHERE c >= 3),
 four AS (SELECT g.graph_id, o.x AS out, count(e.u) AS c FROM graphs g CROSS JOIN (SELECT unnest(range(5)) AS x) o LEFT JOIN edges e ON e.graph_id = g.graph_id AND e.u <> o.x AND e.v <> o.x GROUP BY 1, 2),
 gap AS (SELECT f.graph_id, f.out, p.u, p.v FROM four f JOIN (SELECT a.x AS u, b.x AS v FROM (SELECT unnest(range(5)) AS x) a JOIN (SELECT unnest(range(5)) AS x) b ON a.x < b.x) p ON p.u <> f.out AND p.v <> f.out
   WHERE f.c = 5 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = f.graph_id AND e.u = p.u AND e.v = p.v)),
 k4 AS (SELECT graph_id FROM four WHERE c = 6 UNION SELECT g.graph_id FROM gap g JOIN ends a ON a.graph_id = g.graph_id AND a.src = g.out AND a.dst = g.u JOIN ends b ON b.graph_id = g.graph_id AND b.src = g.out AND b.dst = g.v)"""

_OFFENDS = {
    "p": "m = 10", "d": "m = 10", "2": "graph_id IN (SELECT graph_id FROM k23)", "4": "graph_id IN (SELECT graph_id FROM k4)",
    "o": "graph_id IN (SELECT graph_id FROM k23) OR graph_id IN (SELECT graph_id FROM k4)", "3": "false",
}


def _verdict_sql(cmd: str, bucket: str) -> str:
    return f"WITH {_arcs_sql(bucket)}, {_RULES} SELECT graph_id, '{cmd}' AS cmd, 5 AS n, m, CASE WHEN {_OFFENDS[cmd]} THEN 'NONEMBEDDABLE' ELSE 'OK' END AS verdict FROM graphs"


def _verdicts(cmd: str, bucket: str):
    return lambda spark, d: embedding.verdicts(derive.event_lines(spark, d, bucket), cmd).select(ID, "cmd", "n", "m", "verdict")


def _bip3(cmd: str):
    return lambda spark, d: embedding.verdicts(derive.part_lines(spark, d), cmd).select(ID, "cmd", "verdict")


def _bip3_sql(cmd: str) -> str:
    return f"""WITH full_lines AS (SELECT l_partkey AS graph_id, l_linenumber, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1, 2)
SELECT graph_id, '{cmd}' AS cmd, CASE WHEN count(*) FILTER (flags = 3) >= 3 THEN 'NONEMBEDDABLE' ELSE 'OK' END AS verdict FROM full_lines GROUP BY graph_id"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """The batch table: every command over every five-day graph, counted by n and m. Graphs
    are counted by encoding first, so the kernel and the join see distinct lines only."""
    lines = derive.event_lines(spark, d, "5day").groupBy("g6").agg(F.count("*").alias("weight"))
    decided = embedding.decide(lines, list("pdo234")).join(lines, "g6")
    return collections.statistics(decided, ["cmd", "n", "m"])


def _by_command(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.event_lines(spark, d, "5day").groupBy("g6").agg(F.count("*").alias("weight"))
    return collections.statistics(embedding.decide(lines, list("pdo234")).join(lines, "g6"), ["cmd"])


_STATS_SQL = "WITH {arcs}, {rules}, v AS ({union}) SELECT cmd, n, m, CAST(count(*) AS BIGINT) AS num_graphs, CAST(count(*) FILTER (verdict = 'OK') AS BIGINT) AS num_ok, CAST(count(*) FILTER (verdict <> 'OK') AS BIGINT) AS num_nonembeddable, 'SUCCESS' AS error_flag FROM v GROUP BY 1, 2, 3".format(
    arcs=_arcs_sql("5day"), rules=_RULES, union=" UNION ALL ".join(f"SELECT graph_id, '{c}' AS cmd, 5 AS n, m, CASE WHEN {x} THEN 'NONEMBEDDABLE' ELSE 'OK' END AS verdict FROM graphs" for c, x in _OFFENDS.items())
)


def _first_and_second_half(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = derive.event_lines(spark, d, "day").withColumn("line_no", F.col(ID))
    early = F.pmod(ID, F.lit(1000)) <= 15
    return lines.where(early).select("g6", "line_no"), lines.where(~early).select("g6", "line_no")


_HALVES = f"{_arcs_sql('day')}, {_LINES}, a AS (SELECT g6, min(graph_id) AS line_no FROM lines WHERE graph_id % 1000 <= 15 GROUP BY 1), b AS (SELECT g6, min(graph_id) AS line_no FROM lines WHERE graph_id % 1000 > 15 GROUP BY 1)"


def _g6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.event_lines(spark, d, "5day")
    return graph6.edges_of(lines)


#: The month of a line tells its graph; ids of parts and suppliers stay below 2**43.
_MONTH_BITS = 44


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the components of every month's part-supplier graph, over all lines: a month
    is a sparse graph of its own, and all of them are decided together."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    found = _part_supplier_components(table(spark, d, "lineitem"), F.shiftleft(month.cast("long"), _MONTH_BITS))
    return found.select(F.shiftright("root", _MONTH_BITS).alias("month"), F.col("root").bitwiseAND((1 << _MONTH_BITS) - 1).alias("root"), "vertices")


def _components_all(spark: SparkSession, d: str) -> DataFrame:
    """The same of one graph of all lines."""
    return _part_supplier_components(table(spark, d, "lineitem"), F.lit(0).cast("long"))


def _part_supplier_components(lines: DataFrame, graph) -> DataFrame:
    """Sizes of components; within a graph, parts are even, suppliers odd numbers."""
    edges = lines.select((graph + F.col("l_partkey") * 2).alias("a"), (graph + F.col("l_suppkey") * 2 + 1).alias("b"))
    return components.connected(edges).groupBy("root").agg(F.count("*").alias("vertices"))


def _components_sql(graph: str) -> str:
    """``walk``: (node, root) of the graphs that ``graph`` tells apart."""
    return f"""WITH RECURSIVE g AS (SELECT {graph} AS base, l_partkey, l_suppkey FROM lineitem), e AS (SELECT DISTINCT base + l_partkey * 2 AS a, base + l_suppkey * 2 + 1 AS b FROM g),
 both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 walk(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways UNION
   SELECT w.node, w.root FROM (SELECT x.a AS node, min(walk.root) AS root FROM both_ways x JOIN walk ON walk.node = x.b GROUP BY x.a) w JOIN recurring.walk r ON r.node = w.node WHERE w.root < r.root)"""


_MONTHLY_SQL = f"{_components_sql(f'CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) * {1 << _MONTH_BITS}')} SELECT root // {1 << _MONTH_BITS} AS month, root % {1 << _MONTH_BITS} AS root, count(*) AS vertices FROM walk GROUP BY ALL"
_COMPONENTS_SQL = f"{_components_sql('CAST(0 AS BIGINT)')} SELECT root, count(*) AS vertices FROM walk GROUP BY root"


def _face_count(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.event_lines(spark, d, "5day")
    decided = embedding.decide(lines, "p", certificates=True)
    faces = embedding.faces_by_euler(decided)
    return lines.join(faces, "g6").select(ID, F.col("faces").cast("long").alias("faces"))


_FACES_SQL = f"""WITH RECURSIVE {_arcs_sql('5day')}, reach(graph_id, s, t) AS (SELECT graph_id, x, x FROM graphs CROSS JOIN (SELECT unnest(range(5)) AS x) UNION
 SELECT r.graph_id, r.s, e.dst FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.src = r.t),
 parts AS (SELECT graph_id, count(DISTINCT least_t) AS c FROM (SELECT graph_id, s, min(t) AS least_t FROM reach GROUP BY 1, 2) GROUP BY 1)
SELECT graph_id, CAST(m - 5 + 1 + c AS BIGINT) AS faces FROM graphs JOIN parts USING (graph_id) WHERE m < 10"""


def _certified(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.event_lines(spark, d, "5day").select("g6").unionByName(derive.part_lines(spark, d).select("g6"))
    from rotagraph.session import written

    return written(embedding.decide(lines, list("pdo234"), certificates=True), "certified")


def _generated(spark: SparkSession) -> DataFrame:
    """Seeded random planar graphs of order 12 with 11 to 30 edges: (graph_id, g6)."""
    return collections.random_lines(spark, 200, 12, lambda n, i, seed: kernels.random_planar(n, n - 1 + i % (2 * n - 4), seed))


def _maximal_and_more(spark: SparkSession) -> DataFrame:
    """Maximal planar graphs of order 10, and such with an edge more, by turns."""
    lines = collections.random_lines(spark, 100, 10, lambda n, i, seed: kernels.random_planar(n, 3 * n - 6 + i % 2, seed))
    return collections.statistics(embedding.verdicts(lines, "p"), ["cmd", "n", "m"])


def _all_of_order_six(spark: SparkSession) -> DataFrame:
    return collections.statistics(embedding.decide_rows(collections.all_graphs(spark, 6), "pdo234"), ["cmd"])


def _certificates_checked(spark: SparkSession, d: str) -> DataFrame:
    """(cmd, verdict, checked, failed): certificates of the distinct five-day graphs."""
    from rotagraph.session import written

    decided = written(embedding.decide(derive.event_lines(spark, d, "5day"), list("pdo234"), certificates=True), "certified")
    bad = verify.failures(decided).select("g6").distinct().withColumn("bad", F.lit(1))
    return decided.join(bad, "g6", "left").groupBy("cmd", "verdict").agg(F.count("*").alias("checked"), F.count("bad").alias("failed"))


def _drawings_checked(spark: SparkSession, d: str) -> DataFrame:
    """(drawn, conflicts): drawings of the distinct planar five-day graphs."""
    from rotagraph.session import written

    drawn = written(embedding.decide(derive.event_lines(spark, d, "5day"), "d", True).where("vis_v IS NOT NULL"), "drawn")
    return drawn.agg(F.count("*").alias("drawn")).crossJoin(verify.drawing_conflicts(drawn).agg(F.count("*").alias("conflicts")))  # one row each


def _leda_texts(spark: SparkSession, d: str) -> DataFrame:
    edges = derive.event_edges(spark, d, "5day").groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("e"))
    line = F.transform("e", lambda x: F.concat((x["u"] + 1).cast("string"), F.lit(" "), (x["v"] + 1).cast("string"), F.lit(" 0 |{}|\n")))
    return edges.select(ID, F.concat(F.lit("LEDA.GRAPH\nvoid\nvoid\n-2\n5\n" + "|{}|\n" * 5), F.size("e").cast("string"), F.lit("\n"), F.array_join(line, "")).alias("text"))


def _parsed(df: DataFrame) -> DataFrame:
    return texts.parse_texts(df).select(ID, F.explode("arcs").alias("a")).select(ID, "a.u", "a.v")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Arcs from both ends with their places."""
    arcs = relational.both_ways(derive.event_edges(spark, d, "5day"))
    return arcs.withColumn("pos", F.row_number().over(Window.partitionBy(ID, "src").orderBy("dst")) - 1)


def _disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Where counts of planar graphs by day and by five days differ."""
    stats = [collections.statistics(embedding.verdicts(derive.event_lines(spark, d, b), "p"), ["cmd", "n", "m"]).withColumn("src", F.lit(b)) for b in ("day", "5day")]
    return collections.discrepancies(stats[0].unionByName(stats[1]))


def _cross_checked(spark: SparkSession, d: str) -> DataFrame:
    checked = analysis.cross_checked(derive.event_lines(spark, d, "5day"))
    return checked.groupBy("cmd", "kind").agg(F.count("*").alias("graphs"), F.sum("deletions").alias("deletions"), F.count(F.when(F.col("invalid_ok"), 1)).alias("invalid_ok"))


def _stats_invalid(spark: SparkSession, d: str) -> DataFrame:
    lines = derive.event_lines(spark, d, "5day")
    return analysis.with_invalid(embedding.decide(lines, list(analysis.OTHER_TEST)), analysis.cross_checked(lines))


def _discrepancy_differences(spark: SparkSession, d: str) -> DataFrame:
    """Lines that only one of the collections by day and by five days holds, where counts differ."""
    sides = [derive.event_lines(spark, d, b).select("n", "m", "g6", F.lit(b).alias("src")) for b in ("day", "5day")]
    return analysis.discrepancy_differences(sides[0].unionByName(sides[1]), _disagreements(spark, d))


def _single_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Which texts every command gives for the distinct five-day graphs, and how many edges
    the embeddings have that are read back from them."""
    given = analysis.outputs(embedding.decide(derive.event_lines(spark, d, "5day"), list("pdo234"), certificates=True))
    read = texts.parse_texts(given.withColumn("text", F.when(F.col("verdict") == "OK", F.col("primary"))))
    return read.groupBy("cmd", "verdict").agg(F.count("*").alias("graphs"), F.count("primary").alias("primaries"), F.count("secondary").alias("secondaries"), F.coalesce(F.sum(F.size("arcs")), F.lit(0)).alias("edges"))


def _face_text_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(g6, components, faces): headers and lines of the face texts."""
    texts_ = sections.face_texts(embedding.decide(derive.event_lines(spark, d, "5day"), "p", True))
    count = lambda what: F.regexp_count("text", F.lit(what)).cast("long")
    return texts_.select("g6", count("Component_").alias("components"), count("\n  ").alias("faces"))


def _drawing_text_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(g6, section_lines, rows, columns, labels): of drawings as sections and as pictures."""
    drawn = embedding.decide(derive.event_lines(spark, d, "5day"), "d", True)
    lines = F.size(F.split("section", "\n")) - 1
    parts = F.split("picture", "\n")
    pictures = embedding.rendered(drawn).select("g6", (F.size(parts) - 1).alias("rows"), F.length(parts[0]).alias("columns"), F.regexp_count("picture", F.lit("\\d")).alias("labels"))
    return sections.drawing_sections(drawn).select("g6", lines.alias("section_lines")).join(pictures, "g6")


def queries() -> dict:
    arcs = lambda s, d: derive.event_arcs(s, d)
    edges = lambda s, d: derive.event_edges(s, d)
    five = lambda s, d: derive.event_edges(s, d, "5day")
    graphs = lambda e: e.select(ID).distinct().withColumn("n", F.lit(5))
    pair = lambda s, d, u, v: graphs(five(s, d)).select(ID, F.lit(u).alias("u"), F.lit(v).alias("v"))
    classes = lambda s, d: relational.direction_classes(derive.event_arcs(s, d, "5day"))
    out = {
        "edges_user_events": edges,
        "arcs_user_events": lambda s, d: arcs(s, d).where("src != dst").groupBy(ID, "src", "dst").agg(F.count("*").alias("times")),
        "degree": lambda s, d: relational.degrees(five(s, d)),
        "degree_histogram": lambda s, d: relational.degree_histogram(five(s, d)),
        "direction_class": lambda s, d: relational.direction_classes(derive.event_arcs(s, d, "5day")),
        "in_out_degree": lambda s, d: relational.in_out_degrees(relational.direction_classes(derive.event_arcs(s, d, "5day"))),
        "transpose": lambda s, d: relational.transposed(relational.direction_classes(derive.event_arcs(s, d, "5day"))),
        "clear_direction": lambda s, d: relational.without_directions(relational.direction_classes(derive.event_arcs(s, d, "5day"))),
        "is_neighbor": lambda s, d: relational.are_neighbours(graphs(five(s, d)).select(ID, F.lit(3).alias("u"), F.lit(1).alias("v")), five(s, d)),
        "common_neighbors": lambda s, d: relational.common_neighbours(five(s, d)),
        "contract_edge": lambda s, d: relational.identified(five(s, d), F.lit(1), F.lit(3)),
        "hide_vertex": lambda s, d: relational.without_vertex(five(s, d), F.lit(2)),
        "delete_edges": lambda s, d: relational.without_edges(five(s, d), derive.event_edges(s, d, "5day").where("u = 0")),
        "sizes_euler_filter": lambda s, d: relational.euler_filter(relational.sizes(graphs(five(s, d)), five(s, d))),
        "adjlist_text": lambda s, d: texts.adjacency_texts(graphs(five(s, d)), relational.both_ways(five(s, d))),
        "adjmatrix_text": lambda s, d: texts.matrix_texts(graphs(five(s, d)), five(s, d)),
        "graphml_text": lambda s, d: texts.graphml_texts(graphs(five(s, d)), relational.direction_classes(derive.event_arcs(s, d, "5day"))),
        "text_roundtrip": lambda s, d: texts.parse_texts(texts.adjacency_texts(graphs(five(s, d)), relational.both_ways(five(s, d)), base=1)).select(ID, "n", F.explode("arcs").alias("a")).select(ID, "n", "a.u", "a.v", "a.dir"),
        "g6_encode": lambda s, d: derive.event_lines(s, d, "5day").select(ID, "m", "g6"),
        "g6_roundtrip": _g6_roundtrip,
        "components": _components,
        "components_all": _components_all,
        "face_count": _face_count,
        "stats_by_nm": _stats,
        "stats_rollup": lambda s, d: collections.totals(_stats(s, d)),
        "g6_duplicates": lambda s, d: collections.duplicates(derive.event_lines(s, d, "day").select("g6", F.col(ID).alias("line_no"))),
        "g6_diff": lambda s, d: collections.difference(*_first_and_second_half(s, d)),
        "g6_common_lines": lambda s, d: collections.common_lines(*_first_and_second_half(s, d)),
        "verdict_p_bip3": _bip3("p"),
        "verdict_3_bip3": _bip3("3"),
        "certificate_failures": lambda s, d: verify.failures(_certified(s, d)),
        "visibility_conflicts": lambda s, d: verify.drawing_conflicts(embedding.decide(derive.event_lines(s, d, "5day"), "d", True)),
        "obstruction_kinds": lambda s, d: _certified(s, d).where("verdict = 'NONEMBEDDABLE'").groupBy("cmd", "minor_type").agg(F.count("*").alias("graphs")),
        "depth_first_search": lambda s, d: embedding.depth_first(derive.event_lines(s, d, "5day")),
        "drawing_pictures": lambda s, d: embedding.rendered(embedding.decide(derive.event_lines(s, d, "5day"), "d", True)),
        "random_planar_verdicts": lambda s, d: collections.statistics(embedding.verdicts(_generated(s), "p"), ["cmd", "n", "m"]),
        "edge_deletion": edge_deletion,
        "cross_checked_searches": _cross_checked,
        "stats_with_invalid": _stats_invalid,
        "discrepancy_differences": _discrepancy_differences,
        "single_graph_outputs": _single_outputs,
        "most_edges": lambda s, d: graphs(five(s, d)).select(ID, analysis.most_edges("n").alias("most_edges")),
        "edge_list_text": lambda s, d: sections.edge_list_texts(five(s, d)),
        "drawing_sections": lambda s, d: sections.drawing_sections(embedding.decide(derive.event_lines(s, d, "5day"), "d", True)),
        "face_texts": lambda s, d: sections.face_texts(embedding.decide(derive.event_lines(s, d, "5day"), "p", True)),
        "face_text_sizes": _face_text_sizes,
        "drawing_text_sizes": _drawing_text_sizes,
        "certificates_checked": _certificates_checked,
        "drawings_checked": _drawings_checked,
        "is_neighbor_directed": lambda s, d: relational.are_neighbours_directed(pair(s, d, 3, 1), classes(s, d)),
        "find_edge": lambda s, d: relational.find_edges(pair(s, d, 3, 1), five(s, d)),
        "find_directed_edge": lambda s, d: relational.find_edges(pair(s, d, 3, 1), classes(s, d), directed=True),
        "graph_equality": lambda s, d: relational.equal_graphs(five(s, d), relational.without_vertex(five(s, d), F.lit(2))),
        "max_degree": lambda s, d: relational.maximum_degree(five(s, d)),
        "add_edges": lambda s, d: relational.with_edges(five(s, d), pair(s, d, 4, 0)),
        "insert_arc": lambda s, d: relational.insert_arc(_listed(s, d), graphs(five(s, d)).select(ID, F.lit(0).alias("src"), F.lit(9).alias("dst"), F.lit(None).cast("int").alias("after"))),
        "relabel_vertices": lambda s, d: relational.relabelled(five(s, d), graphs(five(s, d)).select(ID, F.explode(F.expr("sequence(0, 4)")).alias("v")).withColumn("number", 4 - F.col("v"))),
        "keep_marked_edges": lambda s, d: relational.only_edges(five(s, d), five(s, d).where("u = 0")),
        "edge_classes": lambda s, d: embedding.edge_classes(derive.event_lines(s, d, "5day")),
        "blocks": lambda s, d: embedding.blocks(derive.event_lines(s, d, "5day")).withColumn("vertices", F.array_join("vertices", " ")),
        "matrix_roundtrip": lambda s, d: _parsed(texts.matrix_texts(graphs(five(s, d)), five(s, d))),
        "matrix_of_digraphs": lambda s, d: texts.matrix_texts(graphs(five(s, d)), classes(s, d)).select(ID, F.col("text").isNull().alias("refused")),
        "leda_read": lambda s, d: _parsed(_leda_texts(s, d)),
        "count_discrepancies": _disagreements,
        "all_graphs_of_order_6": lambda s, d: _all_of_order_six(s),
        "random_maximal_planar": lambda s, d: _maximal_and_more(s),
        "batch_result_lines": lambda s, d: sections.batch_lines(_by_command(s, d), "events.g6"),
    }
    return out | {f"verdict_{c}5": _verdicts(c, "5day") for c in "pdo234"} | {"verdict_p_users": _verdicts("p", "user")}


#: Depth-first search of five-vertex graphs: at every step the state is a stack and the lists of visited vertices and their parents.
_SEARCH = """near AS (SELECT g.graph_id, list(coalesce(n.ns, []::INTEGER[]) ORDER BY x.x) AS near FROM graphs g CROSS JOIN (SELECT unnest(range(5)) AS x) x
   LEFT JOIN (SELECT graph_id, src, list(dst::INTEGER ORDER BY dst) AS ns FROM ends GROUP BY 1, 2) n ON n.graph_id = g.graph_id AND n.src = x.x GROUP BY 1),
 walk(graph_id, near, stack, visited, parents) AS (SELECT graph_id, near, []::INTEGER[], []::INTEGER[], []::INTEGER[] FROM near UNION ALL
  SELECT graph_id, near, CASE WHEN len(stack) = 0 THEN [root] WHEN nxt IS NULL THEN stack[:len(stack) - 1] ELSE list_append(stack, nxt) END,
   CASE WHEN len(stack) = 0 THEN list_append(visited, root) WHEN nxt IS NULL THEN visited ELSE list_append(visited, nxt) END,
   CASE WHEN len(stack) = 0 THEN list_append(parents, NULL::INTEGER) WHEN nxt IS NULL THEN parents ELSE list_append(parents, stack[-1]) END
  FROM (SELECT *, list_filter(near[coalesce(stack[-1], 0) + 1], lambda x: NOT list_contains(visited, x))[1] AS nxt, list_filter([0, 1, 2, 3, 4]::INTEGER[], lambda x: NOT list_contains(visited, x))[1] AS root FROM walk WHERE len(visited) < 5)),
 found AS (SELECT graph_id, visited[i] AS v, parents[i] AS parent, CAST(i - 1 AS INTEGER) AS number FROM walk CROSS JOIN (SELECT unnest(range(1, 6)) AS i) WHERE len(visited) = 5)"""
_DEPTH_FIRST_SQL = f"""WITH RECURSIVE {_arcs_sql('5day')}, {_SEARCH},
 least AS (SELECT f.graph_id, f.v, f.parent, f.number, least(f.number, coalesce(min(w.number) FILTER (w.v IS DISTINCT FROM f.parent), f.number)) AS own
   FROM found f LEFT JOIN ends e ON e.graph_id = f.graph_id AND e.src = f.v LEFT JOIN found w ON w.graph_id = f.graph_id AND w.v = e.dst GROUP BY 1, 2, 3, 4),
 up(graph_id, v, a) AS (SELECT graph_id, v, v FROM found UNION SELECT u.graph_id, u.v, f.parent FROM up u JOIN found f ON f.graph_id = u.graph_id AND f.v = u.a WHERE f.parent IS NOT NULL)
SELECT l.graph_id, l.v, l.parent, l.number, l.own AS least_ancestor, (SELECT min(d.own) FROM up JOIN least d ON d.graph_id = up.graph_id AND d.v = up.v WHERE up.graph_id = l.graph_id AND up.a = l.v) AS lowpoint FROM least l"""
#: Edges share a block iff no vertex, taken away, leaves them in different components; of
#: the four vertices left, three rounds of least neighbours tell the components.
_BLOCKS_SQL = f"""WITH {_arcs_sql('5day')},
 here AS (SELECT unnest(range(5)) AS x),
 close AS (SELECT graph_id, src, dst FROM ends UNION ALL SELECT g.graph_id, h.x, h.x FROM graphs g CROSS JOIN here h),
 rest AS (SELECT h.x, c.graph_id, c.src, c.dst FROM close c JOIN here h ON c.src <> h.x AND c.dst <> h.x),
 one AS (SELECT graph_id, x, src, min(dst) AS least FROM rest GROUP BY 1, 2, 3),
 two AS (SELECT r.graph_id, r.x, r.src, min(o.least) AS least FROM rest r JOIN one o ON o.graph_id = r.graph_id AND o.x = r.x AND o.src = r.dst GROUP BY 1, 2, 3),
 three AS (SELECT r.graph_id, r.x, r.src, min(o.least) AS least FROM rest r JOIN two o ON o.graph_id = r.graph_id AND o.x = r.x AND o.src = r.dst GROUP BY 1, 2, 3),
 sides AS (SELECT e.graph_id, e.u, e.v, string_agg(t.least::VARCHAR, ' ' ORDER BY t.x) AS block FROM edges e JOIN three t ON t.graph_id = e.graph_id AND t.src = CASE WHEN t.x = e.u THEN e.v ELSE e.u END GROUP BY 1, 2, 3),
 members AS (SELECT graph_id, block, u AS v FROM sides UNION SELECT graph_id, block, v FROM sides)
SELECT graph_id, vertices, edges FROM (SELECT graph_id, block, string_agg(v::VARCHAR, ' ' ORDER BY v) AS vertices FROM members GROUP BY 1, 2)
 JOIN (SELECT graph_id, block, CAST(count(*) AS INTEGER) AS edges FROM sides GROUP BY 1, 2) USING (graph_id, block)"""

_EDGE_CLASSES_SQL = f"""WITH RECURSIVE {_arcs_sql('5day')}, {_SEARCH}
SELECT e.graph_id, CAST(CASE WHEN a.number < b.number THEN e.u ELSE e.v END AS INTEGER) AS u, CAST(CASE WHEN a.number < b.number THEN e.v ELSE e.u END AS INTEGER) AS v,
 CASE WHEN (a.number < b.number AND b.parent = a.v) OR (a.number > b.number AND a.parent = b.v) THEN 'tree' ELSE 'back' END AS class
FROM edges e JOIN found a ON a.graph_id = e.graph_id AND a.v = e.u JOIN found b ON b.graph_id = e.graph_id AND b.v = e.v"""


def edge_deletion(spark: SparkSession, d: str) -> DataFrame:
    """(cmd, deletions, invalid_ok): deletions of an edge from distinct graphs that a search
    decides OK, and graphs where one turns the verdict, which it must not."""
    lines = derive.event_lines(spark, d, "5day")
    fine = embedding.decide(lines, list("234")).where("verdict = 'OK'").select("g6", "cmd")
    smaller = analysis.edge_deleted(fine)
    found = smaller.join(embedding.decide(smaller, list("234")), ["g6", "cmd"])
    return found.groupBy("cmd").agg(F.count("*").alias("deletions"), F.count_distinct(F.when(F.col("verdict") != "OK", F.col("whole"))).alias("invalid_ok"))


def oracle_sql() -> dict[str, str]:
    five = f"WITH {_arcs_sql('5day')}"
    classes = f"{five}, c AS (SELECT graph_id, CASE WHEN f = 0 THEN b ELSE a END AS u, CASE WHEN f = 0 THEN a ELSE b END AS v, CASE WHEN f = 1 AND k = 1 THEN 'UND' ELSE 'OUT' END AS dir FROM (SELECT graph_id, least(src, dst) AS a, greatest(src, dst) AS b, max(CASE WHEN src < dst THEN 1 ELSE 0 END) AS f, max(CASE WHEN src > dst THEN 1 ELSE 0 END) AS k FROM arcs WHERE src <> dst GROUP BY 1, 2, 3))"
    whole = f"WITH {_arcs_sql('5day')}, {_LINES}, {_RULES}, whole AS (SELECT g6, min(graph_id) AS graph_id, min(m) AS m FROM lines GROUP BY g6)"
    # what the other test finds in a graph without the homeomorph that a search looks for
    kinds = {"2": "CASE WHEN graph_id IN (SELECT graph_id FROM k4) THEN 'K4' END", "3": "CASE WHEN m = 10 THEN 'K5' END", "4": "CASE WHEN graph_id IN (SELECT graph_id FROM k23) THEN 'K2,3' END"}
    degree = "deg AS (SELECT graph_id, src AS v, count(*) AS degree FROM ends GROUP BY 1, 2)"
    out = {
        "edges_user_events": f"WITH {_arcs_sql()} SELECT * FROM edges",
        "arcs_user_events": f"WITH {_arcs_sql()} SELECT graph_id, src, dst, count(*) AS times FROM arcs WHERE src <> dst GROUP BY 1, 2, 3",
        "degree": f"{five}, {degree} SELECT * FROM deg",
        "degree_histogram": f"{five}, {degree} SELECT graph_id, degree, count(*) AS vertices FROM deg GROUP BY 1, 2",
        "direction_class": f"{classes} SELECT * FROM c",
        "in_out_degree": f"{classes} SELECT graph_id, v, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT graph_id, u AS v, CASE WHEN dir = 'UND' THEN 1 ELSE 0 END AS i, 1 AS o FROM c UNION ALL SELECT graph_id, v, 1, CASE WHEN dir = 'UND' THEN 1 ELSE 0 END FROM c) GROUP BY 1, 2",
        "transpose": f"{classes} SELECT graph_id, CASE WHEN dir = 'UND' THEN u ELSE v END AS u, CASE WHEN dir = 'UND' THEN v ELSE u END AS v, dir FROM c",
        "clear_direction": f"{classes} SELECT graph_id, least(u, v) AS u, greatest(u, v) AS v, 'UND' AS dir FROM c",
        "is_neighbor": f"{five} SELECT graph_id, 3 AS u, 1 AS v, EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = g.graph_id AND e.u = 1 AND e.v = 3) AS is_neighbor FROM graphs g",
        "common_neighbors": f"{five} SELECT a.graph_id, a.src AS u, b.src AS v, count(*) AS common FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.dst = b.dst AND a.src < b.src GROUP BY 1, 2, 3",
        "contract_edge": f"{five}, x AS (SELECT graph_id, CASE WHEN u = 3 THEN 1 ELSE u END AS a, CASE WHEN v = 3 THEN 1 ELSE v END AS b FROM edges) SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM x WHERE a <> b",
        "hide_vertex": f"{five} SELECT * FROM edges WHERE u <> 2 AND v <> 2",
        "delete_edges": f"{five} SELECT * FROM edges WHERE u <> 0",
        "sizes_euler_filter": f"{five} SELECT graph_id, 5 AS n, m, CASE WHEN m > 9 THEN 'no' WHEN m < 9 THEN 'yes' END AS planar_by_count FROM graphs",
        "adjlist_text": f"{five}, r AS (SELECT g.graph_id, x.x, x.x || ': ' || coalesce(string_agg(e.dst::VARCHAR, ' ' ORDER BY e.dst) || ' ', '') || '-1' || chr(10) AS line FROM graphs g CROSS JOIN (SELECT unnest(range(5)) AS x) x LEFT JOIN ends e ON e.graph_id = g.graph_id AND e.src = x.x GROUP BY 1, 2) SELECT graph_id, 'N=5' || chr(10) || string_agg(line, '' ORDER BY x) AS text FROM r GROUP BY 1",
        "adjmatrix_text": f"{five}, r AS (SELECT g.graph_id, a.x AS a, repeat(' ', CAST(a.x + 1 AS INTEGER)) || coalesce(string_agg(CASE WHEN e.u IS NULL THEN '0' ELSE '1' END, '' ORDER BY b.x) FILTER (b.x > a.x), '') || chr(10) AS line FROM graphs g CROSS JOIN (SELECT unnest(range(5)) AS x) a CROSS JOIN (SELECT unnest(range(5)) AS x) b LEFT JOIN edges e ON e.graph_id = g.graph_id AND e.u = a.x AND e.v = b.x GROUP BY 1, 2) SELECT graph_id, '5' || chr(10) || string_agg(line, '' ORDER BY a) AS text FROM r GROUP BY 1",
        "text_roundtrip": f"{five} SELECT graph_id, 5 AS n, u, v, 'UND' AS dir FROM edges",
        "g6_encode": f"{five}, {_LINES} SELECT graph_id, m, g6 FROM lines",
        "g6_roundtrip": f"{five} SELECT * FROM edges",
        "components": _MONTHLY_SQL,
        "components_all": _COMPONENTS_SQL,
        "face_count": _FACES_SQL,
        "stats_by_nm": _STATS_SQL,
        "stats_rollup": f"SELECT cmd, m, CAST(sum(num_graphs) AS BIGINT) AS num_graphs, CAST(sum(num_ok) AS BIGINT) AS num_ok, CAST(sum(num_nonembeddable) AS BIGINT) AS num_nonembeddable, count(*) AS num_success FROM ({_STATS_SQL}) GROUP BY GROUPING SETS ((cmd, m), (cmd))",
        "g6_duplicates": f"WITH {_arcs_sql('day')}, {_LINES} SELECT g6, min(graph_id) AS first_line, count(*) - 1 AS repeats FROM lines GROUP BY 1 HAVING count(*) > 1",
        "g6_diff": f"WITH {_HALVES} SELECT * FROM a WHERE g6 NOT IN (SELECT g6 FROM b)",
        "g6_common_lines": f"WITH {_HALVES} SELECT a.g6, a.line_no AS left_line, b.line_no AS right_line FROM a JOIN b USING (g6) WHERE a.line_no <> b.line_no",
        "verdict_p_bip3": _bip3_sql("p"),
        "verdict_3_bip3": _bip3_sql("3"),
        "certificate_failures": "SELECT '' AS g6, '' AS reason WHERE false",
        "visibility_conflicts": "SELECT '' AS g6, 0 AS u, 0 AS w, 0 AS v WHERE false",
        "edge_list_text": f"{five} SELECT graph_id, string_agg((u + 1)::VARCHAR || ' ' || (v + 1)::VARCHAR || chr(10), '' ORDER BY u, v) || '0 0' || chr(10) AS text FROM edges GROUP BY 1",
        "batch_result_lines": f"SELECT cmd, 'FILENAME=\"events.g6\" DURATION=\"0.000\"' || chr(10) || '-' || cmd || ' ' || sum(num_graphs)::BIGINT || ' ' || sum(num_ok)::BIGINT || ' ' || sum(num_nonembeddable)::BIGINT || ' SUCCESS' || chr(10) AS text FROM ({_STATS_SQL}) GROUP BY cmd",
        "edge_deletion": f"WITH {_arcs_sql('5day')}, {_LINES}, {_RULES}, whole AS (SELECT g6, min(graph_id) AS graph_id, min(m) AS m FROM lines GROUP BY g6), fine AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS cmd, m FROM whole WHERE NOT ({_OFFENDS[c]})" for c in "234")
        + ") SELECT cmd, CAST(sum(m) AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS invalid_ok FROM fine GROUP BY cmd",
        "certificates_checked": f"WITH {_arcs_sql('5day')}, {_LINES}, {_RULES}, whole AS (SELECT g6, min(graph_id) AS graph_id, min(m) AS m FROM lines GROUP BY g6), v AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS cmd, CASE WHEN {x} THEN 'NONEMBEDDABLE' ELSE 'OK' END AS verdict FROM whole" for c, x in _OFFENDS.items())
        + ") SELECT cmd, verdict, count(*) AS checked, CAST(0 AS BIGINT) AS failed FROM v GROUP BY 1, 2",
        "drawings_checked": f"WITH {_arcs_sql('5day')}, {_LINES} SELECT count(DISTINCT g6) AS drawn, CAST(0 AS BIGINT) AS conflicts FROM lines WHERE m < 10",
        "cross_checked_searches": f"{whole}, fine AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS cmd, {k} AS kind, m FROM whole WHERE NOT ({_OFFENDS[c]})" for c, k in kinds.items())
        + ") SELECT cmd, kind, count(*) AS graphs, CAST(coalesce(sum(m) FILTER (kind IS NOT NULL), 0) AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS invalid_ok FROM fine GROUP BY 1, 2",
        "stats_with_invalid": f"{whole}, v AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS cmd, m, {x} AS bad FROM whole" for c, x in _OFFENDS.items() if c in '234')
        + ") SELECT cmd, 5 AS n, m, count(*) AS num_graphs, count(*) FILTER (NOT bad) AS num_ok, count(*) FILTER (bad) AS num_nonembeddable, CAST(0 AS BIGINT) AS num_invalid_ok FROM v GROUP BY 1, 2, 3",
        "single_graph_outputs": f"{whole}, v AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS cmd, m, {x} AS bad FROM whole" for c, x in _OFFENDS.items())
        + ") SELECT cmd, CASE WHEN bad THEN 'NONEMBEDDABLE' ELSE 'OK' END AS verdict, count(*) AS graphs, count(*) FILTER (bad = (cmd IN ('2', '3', '4'))) AS primaries, count(*) FILTER ((cmd IN ('p', 'o') AND bad) OR (cmd = 'd' AND NOT bad)) AS secondaries, CAST(coalesce(sum(m) FILTER (cmd IN ('p', 'd', 'o') AND NOT bad), 0) AS BIGINT) AS edges FROM v GROUP BY 1, 2",
        "discrepancy_differences": f"""WITH a AS (SELECT m, g6, count(*) AS c FROM (WITH {_arcs_sql('day')}, {_LINES} SELECT m, g6 FROM lines) GROUP BY 1, 2),
 b AS (SELECT m, g6, count(*) AS c FROM (WITH {_arcs_sql('5day')}, {_LINES} SELECT m, g6 FROM lines) GROUP BY 1, 2),
 cells AS (SELECT m FROM (SELECT m, sum(c) AS k FROM a GROUP BY 1) x JOIN (SELECT m, sum(c) AS k FROM b GROUP BY 1) y USING (m) WHERE x.k <> y.k)
SELECT 5 AS n, m, g6, 'day' AS present, '5day' AS absent FROM a SEMI JOIN cells USING (m) WHERE g6 NOT IN (SELECT g6 FROM b)
UNION ALL SELECT 5, m, g6, '5day', 'day' FROM b SEMI JOIN cells USING (m) WHERE g6 NOT IN (SELECT g6 FROM a)""",
        "face_text_sizes": f"""WITH RECURSIVE {_arcs_sql('5day')}, {_LINES}, one AS (SELECT g6, min(graph_id) AS graph_id, min(m) AS m FROM lines WHERE m < 10 GROUP BY g6),
 reach(graph_id, s, t) AS (SELECT DISTINCT e.graph_id, src, src FROM ends e SEMI JOIN one USING (graph_id) UNION SELECT r.graph_id, r.s, e.dst FROM reach r JOIN ends e ON e.graph_id = r.graph_id AND e.src = r.t),
 parts AS (SELECT graph_id, count(*) AS used, count(DISTINCT least_t) AS c FROM (SELECT graph_id, s, min(t) AS least_t FROM reach GROUP BY 1, 2) GROUP BY 1)
SELECT g6, c AS components, CAST(m - used + 2 * c AS BIGINT) AS faces FROM one JOIN parts USING (graph_id)""",
        "drawing_text_sizes": f"WITH {_arcs_sql('5day')}, {_LINES} SELECT DISTINCT g6, CAST(5 + 2 * m + 2 AS INTEGER) AS section_lines, 10 AS rows, m AS columns, 5 AS labels FROM lines WHERE m < 10",
        "most_edges": f"{five} SELECT graph_id, CAST(10 AS BIGINT) AS most_edges FROM graphs",
        "depth_first_search": _DEPTH_FIRST_SQL,
        "edge_classes": _EDGE_CLASSES_SQL,
        "blocks": _BLOCKS_SQL,
        "graphml_text": f"""{classes}, body AS (SELECT graph_id, string_agg('  <edge source="n' || u || '" target="n' || v || '"' || CASE WHEN dir = 'OUT' THEN ' directed="true"' ELSE '' END || '/>' || chr(10), '' ORDER BY u, v) AS e FROM c GROUP BY 1)
SELECT graph_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || ' <graph id="G" edgedefault="undirected">' || chr(10)
 || (SELECT string_agg('  <node id="n' || x || '"/>' || chr(10), '' ORDER BY x) FROM (SELECT unnest(range(5)) AS x)) || e || ' </graph>' || chr(10) || '</graphml>' || chr(10) AS text FROM body""",
        "is_neighbor_directed": f"{five} SELECT graph_id, 3 AS u, 1 AS v, EXISTS (SELECT 1 FROM arcs a WHERE a.graph_id = g.graph_id AND a.src = 3 AND a.dst = 1) AS is_neighbor FROM graphs g",
        "find_edge": f"{five}, e AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS eid FROM edges) SELECT g.graph_id, 3 AS u, 1 AS v, CAST(e.eid AS INTEGER) AS eid FROM graphs g LEFT JOIN e ON e.graph_id = g.graph_id AND e.u = 1 AND e.v = 3",
        "find_directed_edge": f"{classes}, e AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS eid FROM c) SELECT g.graph_id, 3 AS u, 1 AS v, CAST(e.eid AS INTEGER) AS eid FROM graphs g LEFT JOIN e ON e.graph_id = g.graph_id AND ((e.u = 3 AND e.v = 1) OR (dir = 'UND' AND e.u = 1 AND e.v = 3))",
        "graph_equality": f"{five} SELECT graph_id, bool_and(u <> 2 AND v <> 2) AS equal FROM edges GROUP BY 1",
        "max_degree": f"{five}, {degree} SELECT graph_id, max(degree) AS max_degree FROM deg GROUP BY 1",
        "add_edges": f"{five} SELECT graph_id, u, v FROM edges UNION SELECT graph_id, 0, 4 FROM graphs",
        "insert_arc": f"{five} SELECT graph_id, src, dst, CAST(row_number() OVER (PARTITION BY graph_id, src ORDER BY dst) - CASE WHEN src = 0 THEN 0 ELSE 1 END AS INTEGER) AS pos FROM ends UNION ALL SELECT graph_id, 0, 9, 0 FROM graphs",
        "relabel_vertices": f"{five} SELECT graph_id, 4 - v AS u, 4 - u AS v FROM edges",
        "keep_marked_edges": f"{five} SELECT * FROM edges WHERE u = 0",
        "matrix_roundtrip": f"{five} SELECT * FROM edges",
        "matrix_of_digraphs": f"{classes} SELECT graph_id, bool_or(dir = 'OUT') AS refused FROM c GROUP BY 1",
        "leda_read": f"{five} SELECT * FROM edges",
        "count_discrepancies": f"WITH t AS (SELECT m, count(*) AS a FROM (WITH {_arcs_sql('day')} SELECT m FROM graphs) GROUP BY 1), f AS (SELECT m, count(*) AS a FROM (WITH {_arcs_sql('5day')} SELECT m FROM graphs) GROUP BY 1) SELECT 'p' AS cmd, 5 AS n, m, CAST(2 AS BIGINT) AS kinds, CAST(2 AS BIGINT) AS variants FROM t JOIN f USING (m) WHERE t.a <> f.a",
        # fixed values: counts over all 156 graphs of order 6
        "all_graphs_of_order_6": "SELECT cmd, CAST(156 AS BIGINT) AS num_graphs, CAST(ok AS BIGINT) AS num_ok, CAST(156 - ok AS BIGINT) AS num_nonembeddable, 'SUCCESS' AS error_flag FROM (VALUES ('p', 142), ('d', 142), ('o', 80), ('2', 87), ('3', 146), ('4', 92)) t(cmd, ok)",
        "random_maximal_planar": "SELECT 'p' AS cmd, 10 AS n, CAST(24 + i % 2 AS INTEGER) AS m, count(*) AS num_graphs, count(*) FILTER (i % 2 = 0) AS num_ok, count(*) FILTER (i % 2 = 1) AS num_nonembeddable, 'SUCCESS' AS error_flag FROM range(100) t(i) GROUP BY i % 2",
        "random_planar_verdicts": "SELECT 'p' AS cmd, 12 AS n, CAST(11 + i % 20 AS INTEGER) AS m, count(*) AS num_graphs, count(*) AS num_ok, CAST(0 AS BIGINT) AS num_nonembeddable, 'SUCCESS' AS error_flag FROM range(200) t(i) GROUP BY i % 20",
    }
    return out | {f"verdict_{c}5": _verdict_sql(c, "5day") for c in "pdo234"} | {"verdict_p_users": _verdict_sql("p", "user")}

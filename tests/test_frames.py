import os

import pytest
from pyspark.sql import functions as F

from rotagraph.functions import kernels as K
from rotagraph.operators import collections, components, embedding, large, relational, verify
from rotagraph.sources import graph6, texts

ID = "graph_id"


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for i in range(60):
        n = 1 + i % 9
        whole = i % 5 == 0 and n > 4
        edges = K.random_planar(n, 3 * n - 6, i) if whole else K.random_graph(n, n - 1 + i % (2 * n), i) if n > 1 else []
        rows.append((i, n, graph6.format_g6(n, edges), edges))
    return spark.createDataFrame(rows, "graph_id long, n int, g6 string, edges array<struct<u:int,v:int>>")


def edges_of(lines):
    return lines.select(ID, F.explode("edges").alias("e")).select(ID, "e.u", "e.v")


def test_graph6_expressions(lines):
    got = graph6.encode(lines.select(ID, "n"), edges_of(lines)).join(lines.select(ID, F.col("g6").alias("want")), ID).collect()
    assert len(got) == 60 and all(r.g6 == r.want for r in got)
    back = graph6.edges_of(lines)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges_of(lines).collect()))


def test_graph6_errors(spark):
    rows = [("D??",), ("D?",), ("D?@",), (":x",), ("&x",), ("?",), ("D\t?",), (">>sparse6<<:x",), ("@",)]
    got = [r[0] for r in spark.createDataFrame(rows, "g6 string").select(graph6.error_of(F.col("g6"))).collect()]
    assert [x is None for x in got] == [True, False, False, False, False, False, False, False, True]


def test_text_forms(spark, lines):
    one = lines.where("n > 1")
    arcs = relational.both_ways(edges_of(one))
    for base in (0, 1):
        back = texts.parse_texts(texts.adjacency_texts(one, arcs, base)).select(ID, "n", "base", "error", F.explode_outer("arcs").alias("a"))
        assert back.where(f"error IS NOT NULL OR base != {base}").count() == 0
        assert sorted((r[ID], r.a.u, r.a.v) for r in back.where("a IS NOT NULL").collect()) == sorted(map(tuple, edges_of(one).collect()))
    back = texts.parse_texts(texts.matrix_texts(one, edges_of(one)))
    assert sorted((r[ID], a.u, a.v) for r in back.collect() for a in r.arcs) == sorted(map(tuple, edges_of(one).collect()))
    leda = "LEDA.GRAPH\nstring\nint\n-2\n3\n|{}|\n|{}|\n|{}|\n4\n1 2 0 |{}|\n2 1 0 |{}|\n3 3 0 |{}|\n2 3 0 |{}|\n"
    assert texts.parse_graph(leda)["arcs"] == [(0, 1, "UND"), (1, 2, "UND")]
    digraph = texts.parse_graph("N=3\n1: 2 0\n2: 1 3 0\n3: 0\n")
    assert digraph["directed"] and digraph["arcs"] == [(0, 1, "UND"), (1, 2, "OUT")]
    for bad in ("N=2\n0: 0 -1\n1: -1\n", "N=2\n0: 1 -1\n", "2\n 2\n", "LEDA.GRAPH\nvoid\nvoid\n-1\n1\n", "N=0\n", "N=2\n5: -1\n6: -1\n"):
        assert texts.parse_graph(bad)["error"], bad
    assert texts.graphml_texts(one, edges_of(one).withColumn("dir", F.lit("UND"))).count() == one.count()


def test_files_and_data_source(spark, lines, tmp_path):
    from rotagraph.sources.datasource import Graph6Source

    spark.dataSource.register(Graph6Source)
    lines.select("g6").coalesce(3).write.format("graph6").mode("append").save(str(tmp_path / "out"))
    want = sorted(r.g6 for r in lines.select("g6").collect())
    assert sorted(r.g6 for r in spark.read.format("graph6").load(str(tmp_path / "out")).collect()) == want
    files = graph6.read_g6(spark, str(tmp_path / "out" / "*.g6")).collect()
    assert sorted(r.g6 for r in files) == want and max(r.line_no for r in files) > 1
    (tmp_path / "g.txt").write_text("N=2\n0: 1 -1\n1: 0 -1\n")
    assert texts.read_graphs(spark, str(tmp_path / "g.txt")).first().n == 2


@pytest.fixture(scope="module")
def decided(lines):
    from rotagraph.session import written

    return written(embedding.decide(lines, list("pdo234"), certificates=True), "decided")


def test_verdicts_and_certificates(lines, decided):
    for r in decided.select("g6", "cmd", "verdict").collect():
        assert (r.verdict == "NONEMBEDDABLE") == K.OFFENDS[r.cmd](*graph6.parse_g6(r.g6))
    assert verify.failures(decided).collect() == []
    bad = embedding.decide(lines.select(F.lit("D?").alias("g6")), "p").first()
    assert bad.verdict == "ERROR" and bad.error


def test_corrupted_certificates_are_rejected(decided):
    fine = decided.where("cmd = 'p' AND verdict = 'OK' AND m = 3 * n - 6 AND n > 4")
    assert fine.count()
    swapped = fine.withColumn("rotation", F.transform("rotation", lambda r: F.when((r["v"] == 0) & (F.size(r["nbrs"]) > 2), F.struct(r["v"].alias("v"), F.concat(F.array(r["nbrs"][1], r["nbrs"][0]), F.slice(r["nbrs"], 3, 100)).alias("nbrs"))).otherwise(r)))
    touched = swapped.where(F.size(F.col("rotation")[0]["nbrs"]) > 3)
    assert verify.embedding_failures(touched).select("g6").distinct().count() == touched.count() > 0
    cut = decided.where("verdict = 'NONEMBEDDABLE'").withColumn("obstruction", F.slice("obstruction", 2, 1000))
    assert verify.obstruction_failures(cut).select("g6").distinct().count() == cut.select("g6").distinct().count() > 0
    moved = decided.where("cmd = 'd' AND verdict = 'OK' AND m > 4").withColumn("vis_v", F.transform("vis_v", lambda v: v.withField("start", F.lit(0)).withField("end", F.lit(100))))
    assert verify.drawing_conflicts(moved).count() > 0


def test_validation_stays_within_rows(spark, decided):
    """No job runs before the result is asked for, and nothing is joined or broadcast."""
    spark.sparkContext.setJobGroup("validation", "validation")
    try:
        found = verify.failures(decided)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("validation")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and "Broadcast" not in plan


def test_reasons_of_rejected_certificates(spark, decided):
    def reasons(cmd, n, edges, rings=None, obstruction=None):
        """``rings``: (vertex, neighbours)."""
        row = {"g6": graph6.format_g6(n, edges), "cmd": cmd, "n": n, "m": len(edges)}
        row |= {"rotation": rings and [{"v": v, "nbrs": list(r)} for v, r in rings], "obstruction": obstruction and [{"u": u, "v": v} for u, v in obstruction]}
        frame = spark.createDataFrame([tuple(row.get(c) for c in decided.columns)], decided.schema)
        return {r.reason for r in verify.failures(frame).collect()}

    square, around = [(0, 1), (1, 2), (2, 3), (0, 3)], [(0, (1, 3)), (1, (0, 2)), (2, (1, 3)), (3, (0, 2))]
    assert reasons("o", 5, square, [*around, (4, ())]) == reasons("p", 4, square, around) == set()
    assert "an edge is missing" in reasons("p", 4, square, [(0, (1,)), (1, (0, 2)), (2, (1, 3)), (3, (2,))])
    assert "an arc is no edge" in reasons("p", 4, square, [(0, (1, 2)), (1, (0, 2)), (2, (1, 0)), (3, ())])
    assert "arcs do not pair" in reasons("p", 4, square, [(0, (1, 3, 1)), (1, (2,)), (2, (1, 3)), (3, (0, 2))])
    assert "a vertex has two rings" in reasons("p", 4, square, [(0, (1,)), *around[1:], (0, (3,))])
    k4, wheel = [(u, v) for v in range(4) for u in range(v)], [(0, (1, 2, 3)), (1, (0, 3, 2)), (2, (0, 1, 3)), (3, (0, 2, 1))]
    assert reasons("p", 4, k4, wheel) == set() and reasons("o", 4, k4, wheel) == {"a vertex is not on the outer face"}
    assert reasons("p", 4, k4, [(0, (2, 1, 3)), *wheel[1:]]) == {"faces break the formula"}
    # two components: each needs a walk of its own
    assert reasons("o", 7, k4 + [(4, 5), (5, 6), (4, 6)], [*wheel, (4, (5, 6)), (5, (4, 6)), (6, (4, 5))]) == {"a vertex is not on the outer face"}
    longer = [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 4), (3, 4)]
    assert reasons("4", 5, longer, obstruction=longer) == set() and reasons("2", 5, longer, obstruction=longer) == {"not an allowed homeomorph"}
    assert reasons("4", 5, longer[:-1], obstruction=longer) == {"an edge is not in the graph"}
    prism = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (0, 3), (1, 4), (2, 5)]
    assert reasons("p", 6, prism, obstruction=prism) == {"not an allowed homeomorph"}
    apart = k4 + [(4, 5), (5, 6), (4, 6)]  # a cycle of inner vertices that no path covers
    assert reasons("4", 7, apart, obstruction=apart) == {"not an allowed homeomorph"}


def test_edges_within_rows(spark):
    more = [K.random_graph(n, m, n) for n, m in ((1, 0), (2, 1), (63, 900), (150, 4000))]
    texts_ = [graph6.format_g6(n, e) for n, e in zip((1, 2, 63, 150), more, strict=True)] + ["D?", "C~~", ":An", "", "DQc"]
    frame = spark.createDataFrame([(x,) for x in texts_], "g6 string")
    within = frame.select("g6", F.explode(graph6.edge_array(F.col("g6"))).alias("e")).select("g6", "e.u", "e.v")
    assert sorted(map(tuple, within.collect())) == sorted(map(tuple, graph6.edges_of(frame, "g6").collect()))
    assert within.where("length(g6) > 9").count() == 4900


def test_registered_commands(lines):
    embedding.register_command("tri", lambda n, e: any(K.OFFENDS["4"](n, e) for _ in [0]), lambda n, e: e)
    got = embedding.verdicts(lines, ["tri", "4"]).groupBy("graph_id").agg(F.count_distinct("verdict").alias("k")).where("k > 1").count()
    embedding.remove_command("tri")
    assert got == 0
    with pytest.raises(ValueError):
        embedding.decide(lines, ["tri"])
    with pytest.raises(ValueError):
        embedding.register_command("p", lambda n, e: False)


def test_changes(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 2, 3)], "graph_id long, u int, v int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(relational.identified(edges, F.lit(0), F.lit(2))) == [(1, 0, 1), (1, 0, 3)]
    assert rows(relational.without_vertex(edges, F.lit(2))) == [(1, 0, 1)]
    more = spark.createDataFrame([(1, 3, 0), (1, 1, 0), (1, 2, 2)], "graph_id long, u int, v int")
    assert rows(relational.with_edges(edges, more)) == rows(edges.unionByName(more.where("u = 3").selectExpr("graph_id", "v AS u", "u AS v")))
    numbers = spark.createDataFrame([(1, v, 3 - v) for v in range(4)], "graph_id long, v int, number int")
    assert rows(relational.relabelled(relational.relabelled(edges, numbers), numbers)) == rows(edges)
    assert rows(relational.only_edges(edges, edges.where("u = 0"))) == [(1, 0, 1), (1, 0, 2)]
    arcs = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 2, 1)], "graph_id long, src int, dst int, pos int")
    new = spark.createDataFrame([(1, 0, 5, 0), (1, 0, 6, None)], "graph_id long, src int, dst int, after int")
    assert [r.dst for r in relational.insert_arc(arcs, new).orderBy("pos").collect()] == [6, 1, 5, 2]
    arcs = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 2, 2)], "graph_id long, src int, dst int")
    assert rows(relational.direction_classes(arcs)) == [(1, 0, 1, "UND"), (1, 2, 1, "OUT")]
    assert rows(relational.transposed(relational.direction_classes(arcs))) == [(1, 0, 1, "UND"), (1, 1, 2, "OUT")]


def test_all_graphs_of_an_order(spark):
    # fixed values: graphs of orders 1 to 7, and those of order 7 that each command finds OK
    for n, count in enumerate((1, 2, 4, 11, 34), 1):
        assert collections.all_graphs(spark, n).count() == count
    seven = collections.all_graphs(spark, 7)
    got = {r.cmd: (r.num_graphs, r.num_ok) for r in collections.statistics(embedding.decide_rows(seven, "pdo234"), ["cmd"]).collect()}
    assert got == {"p": (1044, 822), "d": (1044, 822), "o": (1044, 277), "2": (1044, 302), "3": (1044, 851), "4": (1044, 360)}


def test_canonical_forms():
    import itertools
    import random

    r = random.Random(1)
    for i in range(40):
        n = r.randrange(2, 8)
        edges = K.random_graph(n, r.randrange(n - 1, n * (n - 1) // 2 + 1), i)
        names = list(range(n))
        r.shuffle(names)
        assert K.canonical(n, edges) == K.canonical(n, K.simple((names[u], names[v]) for u, v in edges))
        moved = [K.simple((p[u], p[v]) for u, v in edges) for p in itertools.islice(itertools.permutations(range(n)), 5040)]
        assert K.canonical(n, edges) in moved


def test_classes_blocks_and_lookups(spark):
    lines = spark.createDataFrame([(1, graph6.format_g6(6, [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5)]))], "graph_id long, g6 string")
    assert sorted((r.u, r.v, r["class"]) for r in embedding.edge_classes(lines).collect()) == [(0, 1, "tree"), (0, 2, "back"), (1, 2, "tree"), (2, 3, "tree"), (4, 5, "tree")]
    assert sorted((r.vertices, r.edges) for r in embedding.blocks(lines).collect()) == [([0, 1, 2], 3), ([2, 3], 1), ([4, 5], 1)]
    classes = spark.createDataFrame([(1, 0, 1, "UND"), (1, 2, 1, "OUT")], "graph_id long, u int, v int, dir string")
    pairs = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 1), (1, 0, 2)], "graph_id long, u int, v int")
    found = lambda df, c: {(r.u, r.v): r[c] for r in df.collect()}
    assert found(relational.find_edges(pairs, classes), "eid") == {(1, 0): 0, (1, 2): 1, (2, 1): 1, (0, 2): None}
    assert found(relational.are_neighbours_directed(pairs, classes), "is_neighbor") == {(1, 0): True, (1, 2): False, (2, 1): True, (0, 2): False}
    graphs = spark.createDataFrame([(1, 3), (2, 2)], "graph_id long, n int")
    both = classes.unionByName(spark.createDataFrame([(2, 0, 1, "UND")], classes.schema))
    assert {r.graph_id: r.text for r in texts.matrix_texts(graphs, both).collect()} == {1: None, 2: "2\n 1\n  \n"}
    assert {r.graph_id: r.g6 for r in graph6.encode(graphs, both).collect()} == {1: None, 2: "A_"}
    a = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1)], "graph_id long, u int, v int")
    b = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (2, 0, 1)], "graph_id long, u int, v int")
    assert {r.graph_id: r.equal for r in relational.equal_graphs(a, b).collect()} == {1: True, 2: False, 3: False}


def test_lines_of_split_files(spark, tmp_path):
    lines = [graph6.format_g6(6, K.random_graph(6, 5 + i % 9, i)) for i in range(500)]
    (tmp_path / "a.g6").write_text(">>graph6<<" + "\n".join(lines) + "\n")
    (tmp_path / "b.g6").write_bytes(b"A_\r\n\r\nA?\r\n")
    from rotagraph.session import settings

    with settings(spark, {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}):
        got = graph6.read_g6(spark, str(tmp_path / "*.g6"))
        assert got.rdd.getNumPartitions() > 1
        rows = {(r.src.rsplit("/", 1)[1], r.line_no): r.g6 for r in got.collect()}
    assert rows == {("a.g6", k): x for k, x in enumerate(lines, 1)} | {("b.g6", 1): "A_", ("b.g6", 3): "A?"}


def test_drawings_are_read_with_their_graphs(spark, tmp_path):
    (tmp_path / "g.txt").write_text("N=2\n0: 1 -1\n1: 0 -1\n<DrawPlanar>\n0: 0 0 0\n1: 1 0 0\n4: 0 0 1\n5: 0 0 1\n</DrawPlanar>\n")
    r = texts.read_drawings(spark, str(tmp_path / "g.txt")).first()
    assert r.n == 2 and [(p.key, p.pos, p.start, p.end) for p in r.places] == [(0, 0, 0, 0), (1, 1, 0, 0), (4, 0, 0, 1), (5, 0, 0, 1)]


def test_components_and_large_graphs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in (1000, 1001, 1002)} == {1000}
    k5 = [(9100 + u, 9100 + v) for u in range(5) for v in range(u)]
    k33 = [(9200 + u, 9203 + v) for u in range(3) for v in range(3)]
    grid = [(9300 + i, 9300 + j) for i, j in K.random_planar(40, 100, 1)]
    df = spark.createDataFrame(k5 + k33 + grid + edges, "a long, b long")
    want = {"p": {9100: "NONEMBEDDABLE", 9200: "NONEMBEDDABLE", 9300: "OK"}, "3": {9100: "OK", 9200: "NONEMBEDDABLE", 9300: "OK"}}
    for cmd, expected in want.items():
        assert {r.root: r.verdict for r in large.component_verdicts(df, cmd).collect() if r.root in expected} == expected


def test_components_of_all_lines(spark, tmp_path):
    from rotagraph.plans import catalog

    # chains of parts and suppliers, each in months of its own
    rows = [(10 * k + i, 10 * k + i + j, f"{1992 + k}-0{1 + i}-15") for k in range(6) for i in range(4) for j in range(2)]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_shipdate string").withColumn("l_shipdate", F.to_date("l_shipdate"))
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    root: dict = {}
    for _ in range(20):
        for part, supplier, _day in rows:
            a, b = 2 * part, 2 * supplier + 1
            root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    want = {r: list(root.values()).count(r) for r in root.values()}
    got = {r.root: r.vertices for r in catalog.queries()["components_all"](spark, str(tmp_path)).collect()}
    assert len(want) == 6 and got == want
    months = {}
    for part, supplier, day in rows:
        months.setdefault((int(day[:4]) * 12 + int(day[5:7]) - 1, 2 * part), set()).add(2 * supplier + 1)
    # within a month a part has two suppliers, which no other part has
    got = {(r.month, r.root): r.vertices for r in catalog.queries()["components"](spark, str(tmp_path)).collect()}
    assert got == {(month, min(part, *suppliers)): 1 + len(suppliers) for (month, part), suppliers in months.items()}


def test_analyses(spark):
    from rotagraph.operators import analysis
    from rotagraph.sources.graph6 import format_g6

    k5 = [(u, v) for v in range(5) for u in range(v)]
    k23 = [(u, v) for u in (0, 1) for v in (2, 3, 4)]
    lines = spark.createDataFrame([(format_g6(5, sorted(e)),) for e in (k5, k23, [(0, 1)])], "g6 string")
    checked = {(r.g6, r.cmd): (r.kind, r.deletions, r.invalid_ok) for r in analysis.cross_checked(lines).collect()}
    k5, k23, one = (r.g6 for r in lines.collect())
    assert checked == {(k5, "3"): ("K5", 10, False), (k23, "3"): (None, 0, False), (k23, "4"): ("K2,3", 6, False), **{(one, c): (None, 0, False) for c in "234"}}
    # an OK that the cross-check holds invalid is counted beside the others
    decided = embedding.decide(lines, list("234"))
    bad = spark.createDataFrame([(k5, "3", True), (k23, "3", False)], "g6 string, cmd string, invalid_ok boolean")
    table = {(r.cmd, r.m): (r.num_graphs, r.num_ok, r.num_invalid_ok) for r in analysis.with_invalid(decided, bad).collect()}
    assert table["3", 10] == (1, 1, 1) and table["3", 6] == (1, 1, 0) and table["2", 6] == (1, 0, 0)
    texts = {(r.g6, r.cmd): (r.primary, r.secondary) for r in analysis.outputs(embedding.decide(lines, list("pdo234"), certificates=True)).collect()}
    whole = "N=5\n" + "".join(f"{v}: {' '.join(str(w) for w in range(5) if w != v)} -1\n" for v in range(5))
    assert texts[k5, "p"] == (None, whole) and texts[k5, "3"] == (None, None) and texts[k5, "d"] == (None, None)
    two = "N=5\n0: 2 3 4 -1\n1: 2 3 4 -1\n2: 0 1 -1\n3: 0 1 -1\n4: 0 1 -1\n"
    assert texts[k23, "2"] == (two, None) and texts[k23, "o"] == (None, two) and texts[one, "p"][0].startswith("N=5\n0: 1 -1\n1: 0 -1\n2: -1\n")
    assert texts[one, "d"][1].count("\n") == 10
    cells = spark.createDataFrame([(5, 6)], "n int, m int")
    sides = spark.createDataFrame([("a", 5, 6, "x"), ("a", 5, 6, "x"), ("b", 5, 6, "y"), ("a", 5, 6, "z"), ("b", 5, 6, "z"), ("a", 5, 7, "w")], "src string, n int, m int, g6 string")
    assert sorted(map(tuple, analysis.discrepancy_differences(sides, cells).collect())) == [(5, 6, "x", "a", "b"), (5, 6, "y", "b", "a")]


def test_command_line(spark, tmp_path, capsys):
    from rotagraph import __main__, __version__

    lists = "N=5\n0: 2 3 4 -1\n1: 2 3 4 -1\n2: 0 1 -1\n3: 0 1 -1\n4: 0 1 -1\n"
    path, out, out2 = (str(tmp_path / x) for x in ("in.txt", "out.txt", "out2.txt"))
    open(path, "w").write(lists)
    assert __main__.main(["version"]) == 0 and capsys.readouterr().out == __version__ + "\n"
    assert __main__.main(["specific", "2", path, out, out2]) == 1 and capsys.readouterr().out == "NONEMBEDDABLE\n"
    assert open(out).read() == lists and not os.path.exists(out2)
    assert __main__.main(["specific", "-d", path, out, out2]) == 0 and capsys.readouterr().out == "OK\n"
    assert open(out).read().startswith("N=5\n0: ") and open(out2).read().count("\n") == 10
    assert __main__.main(["convert", "adjmatrix", path, out]) == 0 and open(out).read().startswith("5\n 0111\n")
    assert __main__.main(["convert", "g6", path]) == 0 and capsys.readouterr().out == "D]o\n"
    open(path, "w").write("N=2\n0: 0 -1\n1: -1\n")
    assert __main__.main(["specific", "p", path]) == 2 and __main__.main(["nothing"]) == 1


def test_collections(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "C")], "line_no int, g6 string")
    b = spark.createDataFrame([(1, "A"), (9, "B")], "line_no int, g6 string")
    assert [tuple(r) for r in collections.duplicates(a).collect()] == [("A", 1, 1)]
    assert [tuple(r) for r in collections.difference(a, b).collect()] == [("C", 4)]
    assert [tuple(r) for r in collections.common_lines(a, b).collect()] == [("B", 2, 9)]
    stats = spark.createDataFrame([("x", "p", 5, 4, 6, 6), ("y", "p", 5, 4, 6, 5), ("x", "p", 5, 5, 1, 1), ("y", "p", 5, 5, 1, 1)], "src string, cmd string, n int, m int, num_graphs long, num_ok long")
    assert [(r.m, r.variants) for r in collections.discrepancies(stats).collect()] == [(4, 2)]


def test_pictures():
    vertices, drawn = K.visibility(4, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)])
    picture = embedding.render([dict(zip(("v", "pos", "start", "end"), x, strict=True)) for x in vertices], [dict(zip(("u", "v", "pos", "start", "end"), x, strict=True)) for x in drawn])
    assert len(picture.splitlines()) == 8 and all(str(v) in picture for v in range(4))


def test_streams(spark, tmp_path, lines):
    from rotagraph import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.g6").write_text(">>graph6<<" + "\n".join(r.g6 for r in lines.collect()) + "\n")
    counts = streaming.running_counts(streaming.verdict_stream(streaming.read_g6_stream(spark, str(tmp_path / "in")), "p4"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.cmd, r.n, r.m): (r.num_graphs, r.num_ok) for r in spark.table("running").collect()}
    batch = collections.statistics(embedding.decide_rows(lines, "p4"), ["cmd", "n", "m"]).collect()
    assert got == {(r.cmd, r.n, r.m): (r.num_graphs, r.num_ok) for r in batch}


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_catalog_agrees_with_sql(spark):
    import duckdb

    from rotagraph.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    found = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        df = found[name](spark, SMALL)
        want = con.sql(sql)
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_forgetting_shared_tables(spark):
    from rotagraph.session import forget, own_dir, written

    kept = written(spark.range(3), "gone")
    assert kept.count() == 3 and forget(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_failed_tables_and_settings(spark):
    from rotagraph.session import own_dir, settings, written

    with pytest.raises(Exception, match="no luck"):
        written(spark.range(3).select(F.raise_error(F.lit("no luck")).alias("x")), "failing")
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert not store.exists(path) or not any("failing" in str(x.getPath()) for x in store.listStatus(path))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with settings(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before

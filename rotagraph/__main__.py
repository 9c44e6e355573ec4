"""Command line: decide, count, convert and generate graphs.

python -m rotagraph verdicts CMD IN.g6          one verdict a line
python -m rotagraph stats CMD IN.g6             counts, as a batch result line
python -m rotagraph convert FORM IN [OUT]       FORM: g6, adjlist, adjmatrix or graphml
python -m rotagraph specific CMD IN [OUT [OUT2]]  one graph in any form: its verdict, after its certificate was checked;
                                                OUT: its embedding or the homeomorph found, OUT2: obstruction or picture
python -m rotagraph random CMD COUNT N [SEED]   counts of seeded random graphs, and of their obstructions
python -m rotagraph planar N [SEED]             a random maximal planar graph, as adjacency list
python -m rotagraph nonplanar N [SEED]          the same with an edge more
python -m rotagraph version
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession, functions as F

from rotagraph import __version__
from rotagraph.functions import kernels
from rotagraph.operators import analysis, collections, embedding, relational, verify
from rotagraph.schema import COMMANDS, OK
from rotagraph.session import written
from rotagraph.sources import graph6, texts


def stats_text(name: str, cmd: str, seconds: float, row) -> str:
    return f'FILENAME="{name}" DURATION="{seconds:.3f}"\n-{cmd} {row.num_graphs} {row.num_ok} {row.num_nonembeddable} {row.error_flag}\n'


def _put(text: str | None, path: str | None) -> None:
    """A text into a file of this machine, or on the screen; nothing where there is none."""
    if text is not None and path:
        with open(path, "w") as f:
            f.write(text)
    elif text is not None:
        print(text, end="")


def _specific(spark: SparkSession, cmd: str, path: str, out: str | None = None, out2: str | None = None) -> int:
    """0: OK, 1: nonembeddable, 2: unreadable or a certificate that does not hold."""
    got = texts.read_graphs(spark, path).withColumn("graph_id", F.lit(0).cast("long"))
    bad = got.where("error IS NOT NULL").first()
    if bad:
        print(bad.error, file=sys.stderr)
        return 2
    edges = got.select("graph_id", F.explode("arcs").alias("a")).select("graph_id", F.least("a.u", "a.v").alias("u"), F.greatest("a.u", "a.v").alias("v")).distinct()
    decided = written(embedding.decide(graph6.encode(got, edges), cmd, certificates=True), "specific")
    wrong = verify.failures(decided).first()
    if wrong:
        print(wrong.reason, file=sys.stderr)
        return 2
    row = analysis.outputs(decided).first()
    print(row.verdict)
    _put(row.primary, out)
    if out2:
        _put(row.secondary, out2)
    return 0 if row.verdict == OK else 1


def main(args: list[str]) -> int:
    if args == ["version"]:
        print(__version__)
        return 0
    if len(args) < (2 if args[:1] in (["planar"], ["nonplanar"]) else 3) or args[0] not in ("verdicts", "stats", "convert", "random", "planar", "nonplanar", "specific"):
        print(__doc__)
        return 1
    spark = SparkSession.builder.getOrCreate()
    if args[0] == "convert":
        got = texts.read_graphs(spark, args[2]).withColumn("graph_id", F.lit(0).cast("long"))
        bad = got.where("error IS NOT NULL").first()
        if bad:
            print(bad.error, file=sys.stderr)
            return 1
        arcs = got.select("graph_id", F.explode("arcs").alias("a")).select("graph_id", "a.u", "a.v", "a.dir")
        edges = relational.without_directions(arcs).select("graph_id", "u", "v").distinct()
        out = {
            "g6": lambda: graph6.encode(got, edges).select(F.col("g6").alias("text")), "adjmatrix": lambda: texts.matrix_texts(got, edges),
            "adjlist": lambda: texts.adjacency_texts(got, relational.both_ways(edges)), "graphml": lambda: texts.graphml_texts(got, arcs),
        }[args[1]]()
        _put(out.first().text + ("\n" if args[1] == "g6" else ""), args[3] if len(args) > 3 else None)
        return 0
    if args[0] in ("planar", "nonplanar"):
        n, seed = int(args[1]), int(args[2]) if len(args) > 2 else 0
        made = kernels.random_planar(n, 3 * n - 6 + (args[0] == "nonplanar"), seed)
        edges = spark.createDataFrame([(0, u, v) for u, v in made], "graph_id long, u int, v int")
        graph = spark.createDataFrame([(0, n)], "graph_id long, n int")
        print(texts.adjacency_texts(graph, relational.both_ways(edges)).first().text, end="")
        return 0
    cmd = args[1].lstrip("-")
    if cmd not in COMMANDS:
        print(f"unknown command {cmd}", file=sys.stderr)
        return 1
    if args[0] == "specific":
        return _specific(spark, cmd, *args[2:5])
    began = time.time()
    if args[0] == "random":
        n, seed = int(args[3]), int(args[4]) if len(args) > 4 else 0
        lines = collections.random_lines(spark, int(args[2]), n, lambda n, i, seed: kernels.random_graph(n, 7 * n // 8 + i % (2 * n), seed), seed)
    else:
        lines = graph6.read_g6(spark, args[2])
    decided = embedding.decide_rows(lines, cmd, certificates=args[0] == "random")
    if args[0] == "verdicts":
        for r in decided.toLocalIterator():
            print(r.g6, r.verdict, r.error or "")
    else:
        if args[0] == "random":
            decided = decided.cache()
        print(stats_text(args[2], cmd, time.time() - began, collections.statistics(decided, ["cmd"]).first()))
        if args[0] == "random":
            for r in decided.where("minor_type IS NOT NULL").groupBy("minor_type").count().orderBy("minor_type").collect():
                print(r.minor_type, r["count"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

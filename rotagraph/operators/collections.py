"""Collections of encoded graphs: duplicates, differences, intersections, statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rotagraph.functions import kernels
from rotagraph.session import written
from rotagraph.sources.graph6 import format_g6, parse_g6


def all_graphs(spark: SparkSession, n: int) -> DataFrame:
    """(g6): one graph of each isomorphism class of order ``n``. Every graph arises from one
    of an order less by a new vertex; extensions are made canonical in Arrow batches and
    repeats go, order by order, each a table."""

    def extend(batches):
        for b in batches:
            for line in b.column(0).to_pylist():
                k, edges = parse_g6(line)
                found = {format_g6(k + 1, kernels.canonical(k + 1, edges + [(u, k) for u in range(k) if subset >> u & 1])) for subset in range(1 << k)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found))], names=["g6"])

    now = spark.createDataFrame([(format_g6(1, []),)], "g6 string")
    for _ in range(n - 1):
        now = written(now.mapInArrow(extend, "g6 string").distinct(), "all-graphs")
        # few lines make much work: they are dealt to all cores
        now = now.repartition(4 * spark.sparkContext.defaultParallelism)
    return now


def random_lines(spark: SparkSession, count: int, n: int, make, seed: int = 0) -> DataFrame:
    """(graph_id, g6) of ``count`` graphs of order ``n``: ``make(n, i, seed + i)`` gives the edges of the i-th."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([format_g6(n, make(n, i, seed + i)) for i in ids], pa.string())], names=["graph_id", "g6"])

    return spark.range(count).mapInArrow(run, "graph_id long, g6 string")


def duplicates(g6: DataFrame) -> DataFrame:
    """(g6, first_line, lines): encodings on more than one line. ``lines``: how many others."""
    return g6.groupBy("g6").agg(F.min("line_no").alias("first_line"), (F.count("*") - 1).alias("repeats")).where("repeats > 0")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(g6, line_no): encodings of ``left`` that ``right`` lacks, with their first lines."""
    first = left.groupBy("g6").agg(F.min("line_no").alias("line_no"))
    return first.join(right.select("g6"), "g6", "left_anti")


def common_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(g6, left_line, right_line): common encodings whose first lines differ."""
    a = left.groupBy("g6").agg(F.min("line_no").alias("left_line"))
    b = right.groupBy("g6").agg(F.min("line_no").alias("right_line"))
    return a.join(b, "g6").where("left_line != right_line")


def discrepancies(stats: DataFrame, variant: str = "src") -> DataFrame:
    """(cmd, n, m, variants): where variants of a collection disagree in their counts."""
    found = stats.groupBy("cmd", "n", "m").agg(F.countDistinct("num_graphs", "num_ok").alias("kinds"), F.count_distinct(variant).alias("variants"))
    return found.where("kinds > 1")


def statistics(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of graphs and verdicts; ``weight`` counts a row several times where there is one."""
    one = F.col("weight") if "weight" in verdicts.columns else F.lit(1)
    count = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, one).otherwise(0))
    return verdicts.groupBy(*by).agg(F.sum(one).alias("num_graphs"), count("OK").alias("num_ok"), count("NONEMBEDDABLE").alias("num_nonembeddable"), F.when(count("ERROR") > 0, "ERROR").otherwise("SUCCESS").alias("error_flag"))


def totals(stats: DataFrame) -> DataFrame:
    """Statistics per m with a TOTALS row (null m), whose flag cell counts SUCCESS rows."""
    good = F.sum(F.when(F.col("error_flag") == "SUCCESS", 1).otherwise(0))
    rolled = stats.rollup("cmd", "m").agg(F.grouping_id().alias("level"), F.sum("num_graphs").alias("num_graphs"), F.sum("num_ok").alias("num_ok"), F.sum("num_nonembeddable").alias("num_nonembeddable"), good.alias("num_success"))
    return rolled.where("level < 2").drop("level")


def table_lines(stats: DataFrame) -> DataFrame:
    """(cmd, line): rows of the count table as text, m ascending, TOTALS last."""
    m = F.coalesce(F.col("m").cast("string"), F.lit("TOTALS"))
    return totals(stats).select("cmd", "m", F.concat_ws("|", F.lit(""), m, "num_graphs", "num_ok", "num_nonembeddable", "num_success", F.lit("")).alias("line"))

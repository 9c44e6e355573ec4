"""Graphs derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rotagraph.operators import relational
from rotagraph.session import table
from rotagraph.sources import graph6

ID = "graph_id"


def _event_types(events: DataFrame) -> DataFrame:
    """(event_type, number): types numbered from 0 in ascending order. There are few types,
    one row each, when the numbering window runs."""
    kinds = events.select("event_type").where("event_type IS NOT NULL").distinct()
    return kinds.withColumn("number", F.row_number().over(Window.orderBy("event_type")) - 1)


def event_arcs(spark: SparkSession, sf_dir: str, bucket: str = "user") -> DataFrame:
    """(graph_id, src, dst): consecutive events of a user ordered by (ts, event_id), within
    the whole table (``user``), a day, or five days; repeats stay, loops too."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    part = {"user": F.lit(0), "day": F.dayofyear("ts"), "5day": F.floor((F.dayofyear("ts") - 1) / 5)}[bucket]
    typed = events.join(_event_types(events), "event_type").withColumn(ID, (F.col("user_id") * 1000 + part).cast("long"))
    order = Window.partitionBy(ID).orderBy("ts", "event_id")
    arcs = typed.select(ID, F.col("number").alias("src"), F.lead("number").over(order).alias("dst"))
    return arcs.where("dst IS NOT NULL")


def event_edges(spark: SparkSession, sf_dir: str, bucket: str = "user") -> DataFrame:
    return relational.undirected(event_arcs(spark, sf_dir, bucket))


def event_lines(spark: SparkSession, sf_dir: str, bucket: str = "user") -> DataFrame:
    """(graph_id, n, m, g6): the five-vertex graphs that have an edge."""
    edges = event_edges(spark, sf_dir, bucket)
    return graph6.encode(edges.select(ID).distinct().withColumn("n", F.lit(5)), edges)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, u, v): for each part, line numbers 1..7 (vertices 0..6) against the three
    return flags A, N, R (vertices 7..9)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias(ID), (F.col("l_linenumber") - 1).cast("int").alias("u"), F.col("l_returnflag").alias("flag"))
    return lines.select(ID, "u", F.when(F.col("flag") == "A", 7).when(F.col("flag") == "N", 8).otherwise(9).alias("v")).distinct()


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph6.encode(edges.select(ID).distinct().withColumn("n", F.lit(10)), edges)

"""Streams of graphs: an extension of the batch operators.

``verdict_stream`` is stateless: each line that arrives is decided on its own.
``running_counts`` keeps counts by command and size. ``window_graphs`` builds one small
graph per tumbling window and key out of a stream of events, with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotagraph.operators.embedding import decide_rows


def read_g6_stream(spark: SparkSession, path: str) -> DataFrame:
    """(g6) of text files as they arrive."""
    lines = spark.readStream.text(path).select(F.regexp_replace(F.rtrim("value"), "^>>graph6<<", "").alias("g6"))
    return lines.where("g6 != ''")


def verdict_stream(lines: DataFrame, cmds: str) -> DataFrame:
    return decide_rows(lines, cmds)


def running_counts(verdicts: DataFrame) -> DataFrame:
    """For the complete output mode."""
    count = lambda v: F.sum((F.col("verdict") == v).cast("int"))
    return verdicts.groupBy("cmd", "n", "m").agg(F.count("*").alias("num_graphs"), count("OK").alias("num_ok"), count("NONEMBEDDABLE").alias("num_nonembeddable"))


def window_graphs(arcs: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, key, edges): the distinct undirected edges of ``arcs`` (ts, key, src, dst) in
    each window; rows later than ``late`` are dropped, as the watermark says."""
    edge = F.struct(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    timely = arcs.where("src != dst").withWatermark("ts", late)
    return timely.groupBy(F.window("ts", width), "key").agg(F.sort_array(F.collect_set(edge)).alias("edges"))

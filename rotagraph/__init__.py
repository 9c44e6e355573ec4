"""Topological graph analytics on Spark: collections of graphs as DataFrames."""

__version__ = "0.1.0"

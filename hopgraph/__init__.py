"""hopgraph: shortest-path analysis of large undirected graphs on Spark DataFrames."""

from hopgraph.operators.graph import Graph

__all__ = ["Graph"]

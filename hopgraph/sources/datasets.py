"""Named data sets end to end (G15) with stored results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopgraph.operators.graph import Graph
from hopgraph.operators.shape import prepare
from hopgraph.sources.edges import read_adjacency, read_edge_csv, read_edge_list, read_ego_networks
from hopgraph.sources.lines import POS

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edge_list": read_edge_list,
    "edge_csv": read_edge_csv,
    "ego": read_ego_networks,
    "adjacency": read_adjacency,
}


def prepare_dataset(
    spark: SparkSession, source: str, form: str, out: str, drop_isolated_nodes: bool = True, force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Read, simplify, symmetrise, relabel and store ``arcs`` and ``nodes``; reuse a stored result."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/arcs/_SUCCESS")
    done = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if force or not done:
        raw = READERS[form](spark, source)
        order = [c for c in POS if c in raw.columns] or ["src", "dst"]
        arcs, nodes = prepare(raw, *order, drop_isolated_nodes=drop_isolated_nodes)
        nodes.write.mode("overwrite").parquet(f"{out}/nodes")
        arcs.write.mode("overwrite").parquet(f"{out}/arcs")
    return spark.read.parquet(f"{out}/arcs"), spark.read.parquet(f"{out}/nodes")


def load_graph(spark: SparkSession, out: str, hub_block: int | None = None) -> Graph:
    """Graph of a prepared data set, isolated nodes of its dictionary included."""
    arcs, nodes = spark.read.parquet(f"{out}/arcs"), spark.read.parquet(f"{out}/nodes")
    extra = {} if hub_block is None else {"hub_block": hub_block}
    return Graph.build(arcs, nodes=nodes, **extra)

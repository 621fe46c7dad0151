"""The prepared graph: arcs laid out for repeated frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.plans.scratch import Scratch

HUB_BLOCK = 1024
BUCKET_ROWS = 5_000_000


class Graph:
    """Symmetric, simple arcs plus per-node facts, stored as two tables.

    ``hops(src, blk, dst, dst_blks)`` splits the neighbours of a hub into
    blocks of about ``hub_block`` arcs by a hash of the neighbour.  A frontier
    row carries the number of blocks of its node (``dst_blks`` of the arc that
    discovered it), so the frontier can fan out to all blocks without another
    join, and a node that owns a third of all arcs is spread over the cluster.
    Beyond ``BUCKET_ROWS`` arcs the table is bucketed by ``(src, blk)``, so the
    joins of an iterative algorithm shuffle the frontier only.

    ``nodes(id, deg, blks)`` has one row per node, isolated ones included.
    """

    def __init__(self, hops: DataFrame, nodes: DataFrame, m: int, n: int, symmetric: bool, hub_block: int):
        self.spark = hops.sparkSession
        self.hops = hops
        self.nodes = nodes
        self.m = m
        self.n = n
        self.symmetric = symmetric
        self.hub_block = hub_block
        self.comp: DataFrame | None = None  # component labels once computed
        self.views: dict[tuple[int, int], object] = {}  # hub views once built

    @classmethod
    def build(
        cls,
        arcs: DataFrame,
        nodes: DataFrame | None = None,
        symmetric: bool = True,
        hub_block: int = HUB_BLOCK,
    ) -> "Graph":
        """``arcs(src, dst)``: distinct, without self loops; both directions when symmetric."""
        spark = arcs.sparkSession
        scratch = Scratch(spark, "graph")
        arcs = scratch.cut(arcs.select("src", "dst"), "arcs")
        ids = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        known = None
        if not symmetric:
            known = arcs.select(F.col("src").alias("id")).union(arcs.select("dst")).distinct()
        if nodes is not None:
            extra = nodes.select("id")
            known = extra.distinct() if known is None else known.union(extra).distinct()
        if known is not None:
            ids = known.join(ids, "id", "left")
        deg = F.coalesce("deg", F.lit(0))
        node_table, n = scratch.save(
            ids.select(
                "id",
                deg.alias("deg"),
                F.greatest(F.ceil(deg / F.lit(hub_block)), F.lit(1)).cast("int").alias("blks"),
            ),
            "nodes",
        )
        hubs = node_table.filter("blks > 1").select("id", "blks")
        laid = (
            arcs.join(hubs.select(F.col("id").alias("src"), F.col("blks").alias("_sb")), "src", "left")
            .join(hubs.select(F.col("id").alias("dst"), F.col("blks").alias("dst_blks")), "dst", "left")
            .select(
                "src",
                F.when(F.col("_sb").isNull(), F.lit(0))
                .otherwise((h("dst", 97) % F.col("_sb")).cast("int"))
                .alias("blk"),
                "dst",
                F.coalesce("dst_blks", F.lit(1)).alias("dst_blks"),
            )
        )
        hops, m = scratch.save(laid, "hops")
        if m > BUCKET_ROWS:
            hops = bucketed(hops, scratch, "hops", "src", "blk")
        return cls(hops, node_table, m, n, symmetric, hub_block)

    @property
    def arcs(self) -> DataFrame:
        return self.hops.select("src", "dst")

    @property
    def edges(self) -> DataFrame:
        """One row per undirected edge."""
        return self.arcs.filter("src < dst")

    def with_blocks(self, df: DataFrame, col: str = "id") -> DataFrame:
        """Attach ``blks`` of node ``col``; nodes outside the graph are dropped."""
        facts = self.nodes.select(F.col("id").alias(col), "blks")
        return df.join(facts, col)

    def expand(self, front: DataFrame) -> DataFrame:
        """Join ``front(..., id, blks)`` with the arcs; adds ``dst, dst_blks``."""
        fan = front.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
        hops = self.hops.select(F.col("src").alias("id"), "blk", "dst", "dst_blks")
        return fan.join(hops, ["id", "blk"]).drop("blk")


def bucketed(df: DataFrame, scratch: Scratch, name: str, *keys: str) -> DataFrame:
    """Store ``df`` so that joins on ``keys`` do not shuffle it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "hopgraph_" + scratch.root.rsplit("-", 1)[1]
    (
        df.repartition(parts, *keys)
        .write.bucketBy(parts, *keys)
        .sortBy(*keys)
        .option("path", scratch.path(f"{name}_bucketed"))
        .saveAsTable(table)
    )
    return spark.table(table)

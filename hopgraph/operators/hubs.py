"""Distances past the hubs of a graph: bounds from searches in bits, and the graph without the hubs.

Every shortest path either meets a hub or runs in the graph without the hubs.  The first kind is
known from the hubs' distances, which cost a few bits per node and hub, and the second from a
search that never enters a hub, so no search spreads over the neighbours of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.operators.bitsearch import WIDTH, BitSweep, in_blocks
from hopgraph.operators.graph import Graph
from hopgraph.plans.scratch import Scratch

#: Most hubs of a graph, and the fewest neighbours of a hub.
HUBS = 512
HUB_DEGREE = 32


class HubView:
    """``far(id, lv)`` of the nodes that reach a hub, and ``rest``, the graph without hubs (None if empty).

    ``lv`` has one slot per block of 64 hubs: the levels ``(k, m)`` of the node, bit i of ``m`` set
    if it is ``k`` hops from hub i of the block.
    """

    def __init__(self, graph: Graph, hubs: DataFrame, count: int):
        scratch = Scratch(graph.spark, "hubs")
        seeds = scratch.cut(in_blocks(hubs.select("id"), "id"), "seeds")
        sweep = BitSweep(graph, seeds.select("block", "id", F.col("bit").alias("m")))
        while sweep.sizes[-1]:
            sweep.advance()
        rows = None
        for k in range(sweep.depth):
            level = sweep.level(k).select("id", F.struct("block", F.lit(k).alias("k"), "m").alias("one"))
            rows = level if rows is None else rows.union(level)
        blocks = -(-count // WIDTH)
        held = rows.groupBy("id").agg(F.collect_list("one").alias("held"))  # levels of at most ``count`` hubs
        slot = lambda i: F.transform(
            F.filter("held", lambda x: x["block"] == i), lambda x: F.struct(x["k"].alias("k"), x["m"].alias("m"))
        )
        self.far = scratch.cut(held.select("id", F.array(*[slot(i) for i in range(blocks)]).alias("lv")), "far")
        ids = seeds.select("id")
        arcs = graph.arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(
            ids.withColumnRenamed("id", "dst"), "dst", "left_anti"
        )
        rest = Graph.build(arcs, symmetric=graph.symmetric, hub_block=graph.hub_block)
        self.rest = rest if rest.m else None

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``up`` and ``low``: shortest way by a hub, and what the hubs' distances rule out; null if no hub."""
        a = self.far.select(F.col("id").alias("src"), F.col("lv").alias("_a"))
        b = self.far.select(F.col("id").alias("dst"), F.col("lv").alias("_b"))
        both = pairs.join(a, "src", "left").join(b, "dst", "left")
        best = F.zip_with("_a", "_b", _ends)
        return both.withColumn("_e", best).select(
            *pairs.columns,
            F.array_min(F.transform("_e", lambda x: x["up"])).alias("up"),
            F.array_max(F.transform("_e", lambda x: x["low"])).alias("low"),
        )


def _ends(a: Column, b: Column) -> Column:
    """Smallest sum and largest difference of the levels of two nodes that share a hub."""
    met = F.flatten(
        F.transform(
            a,
            lambda x: F.transform(
                F.filter(b, lambda y: x["m"].bitwiseAND(y["m"]) != 0),
                lambda y: F.struct((x["k"] + y["k"]).alias("up"), F.abs(x["k"] - y["k"]).alias("low")),
            ),
        )
    )
    return F.struct(
        F.array_min(F.transform(met, lambda z: z["up"])).alias("up"), F.array_max(F.transform(met, lambda z: z["low"])).alias("low")
    )


def hub_view(graph: Graph, least: int = HUB_DEGREE, most: int = HUBS) -> HubView | None:
    """The view past the ``most`` nodes of highest degree with ``least`` neighbours or more; None if there are none."""
    key = (least, most)
    if key not in graph.views:
        top = Scratch(graph.spark, "hubs")
        hubs, count = top.save(graph.nodes.filter(F.col("deg") >= least).orderBy(F.desc("deg"), "id").limit(most).select("id"))
        graph.views[key] = HubView(graph, hubs, count) if count else None
    return graph.views[key]

"""Hierarchical coarsening (H1-H6)."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.operators.embed import embed
from hopgraph.operators.graph import Graph
from hopgraph.operators.shape import top_degree
from hopgraph.operators.traverse import cached_components
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch


def choose_seeds(
    graph: Graph, cluster_sz: int | None = None, fraction: float | None = None, skip_adjacent: bool = True
) -> DataFrame:
    """H1: ``(id, rk)`` - top-degree seeds, optionally without seeds next to an earlier one.

    The greedy pass by rank runs in rounds: a seed with no undecided
    better-ranked neighbour is taken, its neighbours are dropped.
    """
    scratch = Scratch(graph.spark, "seeds")
    count = max(1, graph.n // cluster_sz if cluster_sz else math.floor(graph.n * fraction))
    ranked = number_rows(top_degree(graph.nodes, count), F.desc("deg"), "id", name="rk").select("id", "rk")
    ranked = scratch.cut(ranked)
    if not skip_adjacent:
        return ranked
    a = ranked.select(F.col("id").alias("src"), F.col("rk").alias("rs"))
    b = ranked.select(F.col("id").alias("dst"), F.col("rk").alias("rd"))
    rivals = scratch.cut(graph.arcs.join(a, "src").join(b, "dst"))
    open_ids, left = scratch.save(ranked.select("id"))
    taken = None
    while left:
        live = rivals.join(open_ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
            open_ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
        )
        blocked = live.filter("rd < rs").select(F.col("src").alias("id")).distinct()
        won = scratch.cut(open_ids.join(blocked, "id", "left_anti"))
        lost = rivals.join(won.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        taken = won if taken is None else taken.union(won)
        open_ids, left = scratch.save(open_ids.join(won, "id", "left_anti").join(lost, "id", "left_anti"))
    return number_rows(ranked.join(taken, "id", "left_semi"), "rk", name="rank").select("id", F.col("rank").alias("rk"))


def grow(graph: Graph, seeds: DataFrame, growth: float = 0.0) -> DataFrame:
    """H2: ``(id, center, rk)`` - synchronous rounds of cluster growth.

    Every round a cluster takes its best free neighbours by
    ``2 - degree + links to the cluster``; a node wanted by several clusters
    goes to the seed with the better rank.  ``growth = 0`` takes one node per
    round as the sequential rule does; with ``growth = g`` a cluster takes
    ``ceil(g * size)``, so large clusters need a logarithmic number of rounds.
    A component without a seed becomes a cluster of its own around its smallest
    node, ranked after all seeds, so that every node has a cluster.
    """
    scratch = Scratch(graph.spark, "grow")
    deg = graph.nodes.select("id", "deg", "blks")
    new = scratch.cut(deg.join(seeds, "id").select("id", "blks", F.col("id").alias("center"), "rk"), "new0")
    names = ["new0"]
    schema = new.schema
    links = None
    for r in count(1):
        members = scratch.read_many(names, schema)
        touch = graph.expand(new).groupBy("center", "rk", F.col("dst").alias("id")).agg(
            F.first("dst_blks").alias("blks"), F.count(F.lit(1)).alias("links")
        )
        if links is not None:
            touch = touch.union(links).groupBy("center", "rk", "id").agg(
                F.first("blks").alias("blks"), F.sum("links").alias("links")
            )
        links, left = scratch.save(
            touch.join(members.select("id"), "id", "left_anti").select("center", "rk", "id", "blks", "links"), f"links{r}"
        )
        if not left:
            break
        scored = links.join(deg.select("id", "deg"), "id").withColumn("score", F.lit(2) - F.col("deg") + F.col("links"))
        if growth <= 0:
            pick = F.max_by(F.struct("id", "blks"), F.struct(F.col("score"), (-F.col("id")).alias("n")))
            best = scored.groupBy("center", "rk").agg(pick.alias("p")).select("center", "rk", "p.id", "p.blks")
        else:
            sizes = members.groupBy("center").agg(F.ceil(F.count(F.lit(1)) * growth).alias("take"))
            part = h("id", 5) % 16  # rank inside slices first, so one cluster does not fill one task
            order = [F.desc("score"), F.col("id")]
            near = scored.join(sizes, "center")
            near = near.withColumn("rn", F.row_number().over(W.partitionBy("center", part).orderBy(*order))).filter("rn <= take")
            near = near.withColumn("rn", F.row_number().over(W.partitionBy("center").orderBy(*order))).filter("rn <= take")
            best = near.select("center", "rk", "id", "blks")
        new = scratch.cut(
            best.groupBy("id").agg(
                F.first("blks").alias("blks"), F.min_by("center", "rk").alias("center"), F.min("rk").alias("rk")
            ).select("id", "blks", "center", "rk"),
            f"new{r}",
        )
        names.append(f"new{r}")
    taken = scratch.read_many(names, schema).select("id", "center", "rk")
    alone, left = scratch.save(cached_components(graph).join(taken.select("id"), "id", "left_anti"), "alone")
    if not left:
        return taken
    after = (seeds.agg(F.max("rk")).first()[0] or 0) + 1
    centers = number_rows(alone.select("comp").distinct(), "comp", name="nr")
    extra = alone.join(centers, "comp").select("id", F.col("comp").alias("center"), (F.col("nr") + after).alias("rk"))
    return scratch.cut(taken.union(extra), "members")


def quotient(arcs: DataFrame, members: DataFrame) -> DataFrame:
    """H3: arcs between the clusters of ``members(id, rk)``, simple and symmetric."""
    a = members.select(F.col("id").alias("src"), F.col("rk").alias("_a"))
    b = members.select(F.col("id").alias("dst"), F.col("rk").alias("_b"))
    return (
        arcs.join(a, "src").join(b, "dst").filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
    )


class Hierarchy:
    """Levels of a coarsened graph.

    ``level_nodes(level, id, center, up_id)`` and ``level_arcs(level, src, dst)``;
    ``up_id`` is the node of the next level that stands for the cluster.
    """

    def __init__(self, level_nodes: DataFrame, level_arcs: DataFrame, depth: int):
        self.level_nodes, self.level_arcs, self.depth = level_nodes, level_arcs, depth

    @classmethod
    def build(
        cls, graph: Graph, cluster_sz: int | None = 10, fraction: float | None = None, depth: int = 3, proto_sz: int = 10,
        skip_adjacent: bool = True, growth: float = 0.0,
    ) -> "Hierarchy":
        scratch = Scratch(graph.spark, "hierarchy")
        nodes, arcs = [], [graph.arcs.select(F.lit(0).alias("level"), "src", "dst")]
        current, level = graph, 0
        while level < depth and current.n > proto_sz:
            seeds = scratch.cut(choose_seeds(current, cluster_sz, fraction, skip_adjacent))
            members = grow(current, seeds, growth)
            nodes.append(members.select(F.lit(level).alias("level"), "id", "center", F.col("rk").alias("up_id")))
            upper = scratch.cut(quotient(current.arcs, members))
            arcs.append(upper.select(F.lit(level + 1).alias("level"), "src", "dst"))
            current = Graph.build(upper, nodes=members.select(F.col("rk").alias("id")).distinct(), hub_block=graph.hub_block)
            level += 1
        node_table = nodes[0]
        for t in nodes[1:]:
            node_table = node_table.union(t)
        arc_table = arcs[0]
        for t in arcs[1:]:
            arc_table = arc_table.union(t)
        return cls(scratch.cut(node_table), scratch.cut(arc_table), level)

    def climb(self, pairs: DataFrame) -> DataFrame:
        """H4: first level on which both nodes share a cluster, and its centre; null when they never do."""
        state = pairs.select("src", "dst").distinct().select(
            "src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"),
            F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("center"),
        )
        for k in range(self.depth):
            here = self.level_nodes.filter(F.col("level") == k)
            left = here.select(F.col("id").alias("a"), F.col("center").alias("ca"), F.col("up_id").alias("ua"))
            right = here.select(F.col("id").alias("b"), F.col("center").alias("cb"), F.col("up_id").alias("ub"))
            met = F.col("level").isNull() & (F.col("ca") == F.col("cb"))
            state = state.join(left, "a", "left").join(right, "b", "left").select(
                "src", "dst", F.col("ua").alias("a"), F.col("ub").alias("b"),
                F.when(met, F.lit(k)).otherwise(F.col("level")).alias("level"),
                F.when(met, F.col("ca")).otherwise(F.col("center")).alias("center"),
            )
        return state.select("src", "dst", "level", "center")

    def level_graph(self, level: int) -> Graph:
        nodes = None
        if level:
            nodes = self.level_nodes.filter(F.col("level") == level - 1).select(F.col("up_id").alias("id")).distinct()
        return Graph.build(self.level_arcs.filter(F.col("level") == level).select("src", "dst"), nodes=nodes)

    def embed_levels(self, method: str = "uniform", **settings) -> DataFrame:
        """H5: ``(level, id, v)`` - every level embedded by name."""
        out = None
        for k in range(self.depth + 1):
            g = self.level_graph(k)
            if not g.m:
                continue
            part = embed(g, method, **settings).select(F.lit(k).alias("level"), "id", "v")
            out = part if out is None else out.union(part)
        return out

    def save(self, path: str) -> None:
        """H6."""
        self.level_nodes.write.mode("overwrite").parquet(f"{path}/level_nodes")
        self.level_arcs.write.mode("overwrite").parquet(f"{path}/level_arcs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Hierarchy":
        nodes = spark.read.parquet(f"{path}/level_nodes")
        depth = nodes.agg(F.max("level")).first()[0] + 1
        return cls(nodes, spark.read.parquet(f"{path}/level_arcs"), depth)

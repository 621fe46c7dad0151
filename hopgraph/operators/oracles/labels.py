"""Exact 2-hop labels and their node orders."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles.base import UNREACHABLE, Oracle
from hopgraph.operators.oracles.landmark import ranking
from hopgraph.operators.stats import subtree_sizes
from hopgraph.operators.traverse import Sweep, sweep_from
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch


def node_order(graph: Graph, by: str = "degree", seed: int = 0, samples: int = 200) -> DataFrame:
    """``(id, rk)``, dense, best hub first."""
    return number_rows(ranking(graph, by, seed, samples), "key", "id", name="rk").select("id", "rk")


def sampled_tree_order(
    graph: Graph, roots: int = 16, per_round: int = 16, seed: int = 0
) -> DataFrame:
    """Hub order from sampled shortest-path trees.

    Score a node by the tree descendants it covers over all sampled trees, take
    the best nodes, cut their subtrees, score again, until no tree node is left.
    The first round takes ``per_round`` nodes, each later one twice as many, so
    that rounds follow the logarithm of the graph.  Nodes in no tree follow by degree.
    """
    spark = graph.spark
    scratch = Scratch(spark, "treeorder")
    picks = graph.nodes.orderBy(h("id", seed), "id").limit(roots).select("id")
    sweep = sweep_from(graph, picks, carry=("parent",)).run()
    live = scratch.cut(sweep.table().select("src", "id", "parent", "d", F.lit(False).alias("gone")))
    taken = None
    for r in count():
        size = _live_sizes(live, sweep.depth, scratch)
        score = size.groupBy("id").agg(F.sum("size").alias("score"))
        if taken is not None:
            score = score.join(taken, "id", "left_anti")
        best, n = scratch.save(
            score.orderBy(F.desc("score"), "id").limit(per_round << min(r, 24)).select("id", F.lit(r).alias("round"), "score")
        )
        if not n:
            break
        taken = best if taken is None else taken.union(best)
        live = _cut_subtrees(live, best, sweep.depth, scratch)
    left = graph.nodes.select("id", F.lit(r).alias("round"), F.col("deg").alias("score"))
    if taken is not None:
        left = taken.union(left.join(taken, "id", "left_anti"))
    return number_rows(left, "round", F.desc("score"), "id", name="rk").select("id", "rk")


def _live_sizes(live: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    parts, below = None, None
    one = F.lit(1).cast("bigint")
    for k in range(depth, -1, -1):
        here = live.filter((F.col("d") == k) & ~F.col("gone")).select("src", "id", "parent")
        if below is None:
            here = here.withColumn("size", one)
        else:
            kids = below.groupBy("src", F.col("parent").alias("id")).agg(F.sum("size").alias("kids"))
            here = here.join(kids, ["src", "id"], "left").select(
                "src", "id", "parent", (one + F.coalesce("kids", F.lit(0))).alias("size")
            )
        below = scratch.cut(here)
        parts = below if parts is None else parts.union(below)
    return parts


def _cut_subtrees(live: DataFrame, best: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Mark the subtrees of ``best`` gone, from the roots downward."""
    hit = best.select("id", F.lit(True).alias("hit"))
    marked = scratch.cut(live.join(hit, "id", "left").withColumn("gone", F.col("gone") | F.coalesce("hit", F.lit(False))).drop("hit"))
    parts = above = marked.filter("d = 0").select("src", "id", "parent", "d", "gone")
    for k in range(1, depth + 1):
        up = above.select("src", F.col("id").alias("parent"), F.col("gone").alias("up"))
        here = marked.filter(F.col("d") == k).join(up, ["src", "parent"]).select(
            "src", "id", "parent", "d", (F.col("gone") | F.col("up")).alias("gone")
        )
        above = scratch.cut(here)
        parts = parts.union(above)
    return parts


class LabelOracle(Oracle):
    """Pruned labels in table form ``labels(id, hub, d)``.

    Built by rank batches: one sweep serves all hubs of a batch and is pruned
    against the finished labels; afterwards labels covered by a better hub of
    the same batch are removed by the same rule.  The result is the canonical
    labelling - hub h labels v unless a better-ranked k lies on a shortest h-v
    path - whatever the batch sizes are.
    """

    @classmethod
    def build(
        cls, graph: Graph, by: str = "degree", order: DataFrame | None = None, first: int = 16, growth: int = 8, seed: int = 0
    ) -> "LabelOracle":
        scratch = Scratch(graph.spark, "labels")
        order = scratch.cut(node_order(graph, by, seed) if order is None else order, "order")
        schema = "id bigint, hub bigint, rk bigint, d int"
        empty = graph.spark.createDataFrame([], schema)
        scratch.write(empty, "empty")
        done = ["empty"]
        lo, size = 0, first
        while lo < graph.n:
            hubs = scratch.cut(order.filter((F.col("rk") >= lo) & (F.col("rk") < lo + size)), f"hubs{lo}")
            finished = scratch.read_many(done, empty.schema)
            reach = scratch.cut(
                finished.join(hubs.select("id"), "id", "left_semi").select(
                    F.col("id").alias("h"), F.col("hub").alias("k"), F.col("d").alias("dh")
                ),
                f"reach{lo}",
            )

            def uncovered(fresh: DataFrame, d: int) -> DataFrame:
                return _drop_covered(fresh.withColumn("d", F.lit(d)), reach, finished).drop("d")

            seeds = hubs.select(F.col("id").alias("h"), "id", "rk")
            prune = uncovered if lo else None
            found = Sweep(graph, seeds, ("h",), fixed=("rk",)).run(refine=prune).table()
            found = found.select("h", "rk", "id", "d")
            better = found.join(hubs.select("id"), "id", "left_semi").select(
                F.col("id").alias("h"), F.col("h").alias("k"), F.col("rk").alias("krk"), F.col("d").alias("dh")
            )
            inner = found.select(F.col("id").alias("v"), F.col("h").alias("k"), F.col("d").alias("dk"))
            covered = (
                found.join(better, "h")
                .filter("krk < rk")
                .withColumnRenamed("id", "v")
                .join(inner, ["v", "k"])
                .filter("dh + dk <= d")
                .select("h", F.col("v").alias("id"))
                .distinct()
            )
            kept = found.join(covered, ["h", "id"], "left_anti").select("id", F.col("h").alias("hub"), "rk", "d")
            scratch.write(kept, f"labels{lo}")
            done.append(f"labels{lo}")
            lo, size = lo + size, size * growth
        return cls({"labels": scratch.read_many(done, empty.schema)}, {"by": by, "first": first, "growth": growth})

    def query(self, pairs: DataFrame) -> DataFrame:
        """Smallest sum over shared hubs.

        The second join is on (node, hub), so a hub that labels every node is
        still spread over all partitions.
        """
        labels = self.tables["labels"]
        a = labels.select(F.col("id").alias("src"), "hub", F.col("d").alias("d1"))
        b = labels.select(F.col("id").alias("dst"), "hub", F.col("d").alias("d2"))
        asked = pairs.select("src", "dst").distinct()
        met = asked.join(a, "src").join(b, ["dst", "hub"]).groupBy("src", "dst").agg(
            F.min(F.col("d1") + F.col("d2")).alias("est")
        )
        return asked.join(met, ["src", "dst"], "left").select(
            "src", "dst", F.coalesce("est", F.lit(UNREACHABLE)).alias("est")
        )


def _drop_covered(fresh: DataFrame, reach: DataFrame, finished: DataFrame) -> DataFrame:
    own = finished.select("id", F.col("hub").alias("k"), F.col("d").alias("dk"))
    covered = (
        fresh.select("h", "id", "d")
        .join(reach, "h")
        .join(own, ["id", "k"])
        .filter("dh + dk <= d")
        .select("h", "id")
        .distinct()
    )
    return fresh.join(covered, ["h", "id"], "left_anti")


__all__ = ["LabelOracle", "node_order", "sampled_tree_order", "subtree_sizes"]

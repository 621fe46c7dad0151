"""k-level approximate oracle after Thorup and Zwick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import P, h
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles.base import Oracle
from hopgraph.operators.traverse import Sweep, nearest_seed
from hopgraph.plans.scratch import Scratch

FAR = 1 << 30


def sample_levels(graph: Graph, k: int, seed: int = 0) -> DataFrame:
    """``(id, top)``: node id belongs to A_0 .. A_top; each step keeps p = n^(-1/k).

    The node with the smallest hash is kept on every level, so A_{k-1} is never empty.
    """
    cut = int(P * graph.n ** (-1.0 / k))
    best = graph.nodes.select(F.min(F.struct(h("id", seed + 1), F.col("id").alias("id")))["id"]).scalar()
    top = F.lit(0)
    keep = F.lit(True)
    for i in range(1, k):
        keep = keep & ((h("id", seed + i) < cut) | (F.col("id") == best))
        top = F.when(keep, F.lit(i)).otherwise(top)
    return graph.nodes.select("id", top.alias("top"))


class ApproxOracle(Oracle):
    """Answers are at least d and at most (2k-1) d."""

    @classmethod
    def build(cls, graph: Graph, k: int = 2, seed: int = 0) -> "ApproxOracle":
        scratch = Scratch(graph.spark, "ado")
        levels = scratch.cut(sample_levels(graph, k, seed))
        # pivots: nearest member of A_i for each node, and delta_k = infinity
        piv = graph.nodes.select("id")
        for i in range(1, k):
            near = nearest_seed(graph, levels.filter(F.col("top") >= i))
            piv = scratch.cut(
                piv.join(
                    near.select("id", F.col("seed").alias(f"p{i}"), F.col("d").alias(f"delta{i}")), "id", "left"
                )
            )
        piv = piv.withColumn("p0", F.col("id")).withColumn("delta0", F.lit(0))
        # clusters: search from w (top level i) while d < delta_{i+1}(v)
        edge = F.array(*[F.coalesce(f"delta{i}", F.lit(FAR)) for i in range(1, k)], F.lit(FAR))
        limits = scratch.cut(piv.select("id", edge.alias("lim")))

        def inside(fresh: DataFrame, d: int) -> DataFrame:
            return fresh.join(limits, "id").filter(F.get("lim", F.col("top")) > d).drop("lim")

        seeds = levels.select(F.col("id").alias("w"), "id", "top")
        sweep = Sweep(graph, seeds, ("w",), fixed=("top",)).run(refine=inside)
        pivots = [
            piv.filter(F.col(f"p{i}").isNotNull()).select(
                F.lit(i).alias("level"), "id", F.col(f"p{i}").alias("p"), F.col(f"delta{i}").alias("delta")
            )
            for i in range(k)
        ]
        table = pivots[0]
        for p in pivots[1:]:
            table = table.union(p)
        return cls(
            {"pivot": scratch.cut(table), "bunch": sweep.table().select("id", "w", "d")}, {"k": k, "seed": seed}
        )

    def query(self, pairs: DataFrame) -> DataFrame:
        """Walk up the levels, swapping the ends, until the pivot is in the other bunch.

        ``k`` is small and fixed, so the walk is unrolled into 2 joins per level.
        """
        k = self.settings["k"]
        pivot, bunch = self.tables["pivot"], self.tables["bunch"]
        state = pairs.select("src", "dst").distinct().select(
            "src", "dst", F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(None).cast("int").alias("est")
        )
        for i in range(k):
            step = pivot.filter(F.col("level") == i).select(F.col("id").alias("u"), F.col("p").alias("w"), "delta")
            hit = bunch.select(F.col("id").alias("v"), "w", F.col("d").alias("dv"))
            state = state.join(step, "u", "left").join(hit, ["v", "w"], "left").select(
                "src",
                "dst",
                F.col("v").alias("u"),  # swapped for the next level
                F.col("u").alias("v"),
                F.coalesce("est", F.col("delta") + F.col("dv")).alias("est"),
            )
        return state.select("src", "dst", "est")

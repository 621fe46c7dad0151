"""Landmark choice and landmark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles.base import Oracle, attach
from hopgraph.operators.stats import closeness_sampled
from hopgraph.operators.traverse import distances, landmark_table
from hopgraph.plans.scratch import Scratch


def ranking(graph: Graph, by: str = "degree", seed: int = 0, samples: int = 200) -> DataFrame:
    """``(id, key)``, best node first by ``(key, id)``."""
    if by == "degree":
        return graph.nodes.select("id", (-F.col("deg")).cast("double").alias("key"))
    if by == "random":
        return graph.nodes.select("id", h("id", seed).cast("double").alias("key"))
    if by == "closeness":
        mean = closeness_sampled(graph, samples, seed).select("id", "mean_d")
        return graph.nodes.join(mean, "id", "left").select(
            "id", F.coalesce("mean_d", F.lit(float("inf"))).alias("key")
        )
    raise ValueError(f"unknown order {by!r}")


def choose_landmarks(
    graph: Graph, count: int, by: str = "degree", margin: int = 0, seed: int = 0, samples: int = 200
) -> DataFrame:
    """O1: the greedy choice in rank order that skips nodes near a chosen one.

    Works in windows of the best candidates that are still free.  Only the
    conflicts inside one window (its size is a multiple of ``count``) are
    settled on the driver; what they cover is found by a bounded sweep.  When
    no free node is left, the best unused nodes fill up the set.
    """
    order = ranking(graph, by, seed, samples)
    if margin <= 0:
        return order.orderBy("key", "id").limit(count).select("id")
    spark = graph.spark
    scratch = Scratch(spark, "landmarks")
    order = scratch.cut(order)
    window = max(4 * count, 64)
    chosen: list[int] = []
    free = order
    while len(chosen) < count:
        cands = scratch.cut(free.orderBy("key", "id").limit(window))
        near = distances(graph, cands, max_hops=margin).join(cands.select("id"), "id", "left_semi")
        close = {(r.src, r.id) for r in near.select("src", "id").collect()}
        ranked = [r.id for r in cands.orderBy("key", "id").collect()]
        if not ranked:
            break
        fresh: list[int] = []
        for v in ranked:
            if len(chosen) < count and all((v, w) not in close for w in fresh):
                fresh.append(v)
                chosen.append(v)
        if len(chosen) < count:
            centre = spark.createDataFrame([(v,) for v in chosen], "id bigint")
            covered = distances(graph, centre, max_hops=margin).select("id").distinct()
            free = order.join(covered, "id", "left_anti")
    picked = spark.createDataFrame([(v,) for v in chosen], "id bigint")
    if len(chosen) < count:
        rest = order.join(picked, "id", "left_anti").orderBy("key", "id").limit(count - len(chosen))
        picked = picked.union(rest.select("id"))
    return picked


def pack(table: DataFrame, landmarks: list[int]) -> DataFrame:
    """E6 in packed form: ``(id, dv)`` with one slot per landmark, null if unreachable.

    The landmark list is a parameter of fixed size; each slot is a plain
    aggregate, so the packing combines map-side.
    """
    slots = [F.max(F.when(F.col("lm") == lm, F.col("d"))) for lm in landmarks]
    return table.groupBy("id").agg(F.array(*slots).alias("dv"))


class LandmarkOracle(Oracle):
    """O2: upper bound min_l d(u,l) + d(l,v); O2b: lower bound max_l |d(u,l) - d(l,v)|."""

    @classmethod
    def build(
        cls, graph: Graph, count: int = 16, by: str = "degree", margin: int = 0, seed: int = 0
    ) -> "LandmarkOracle":
        scratch = Scratch(graph.spark, "lmoracle")
        chosen = [r.id for r in choose_landmarks(graph, count, by, margin, seed).collect()]  # count rows
        ids = graph.spark.createDataFrame([(v,) for v in chosen], "id bigint")
        table = landmark_table(graph, ids)
        return cls({"vec": scratch.cut(pack(table, chosen))}, {"landmarks": chosen})

    def _ends(self, pairs: DataFrame) -> DataFrame:
        return attach(pairs.select("src", "dst"), self.tables["vec"], "dv")

    def query(self, pairs: DataFrame) -> DataFrame:
        upper = F.array_min(F.zip_with("dv_s", "dv_d", lambda a, b: a + b))
        return self._ends(pairs).select("src", "dst", upper.alias("est"))

    def lower(self, pairs: DataFrame) -> DataFrame:
        bound = F.array_max(F.zip_with("dv_s", "dv_d", lambda a, b: F.abs(a - b)))
        return self._ends(pairs).select("src", "dst", bound.alias("est"))

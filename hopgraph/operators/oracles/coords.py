"""Coordinate oracles: inner-product coordinates from landmark distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.vectors import dot
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles.base import Oracle, answer_all, attach, home_table
from hopgraph.operators.oracles.landmark import choose_landmarks, pack
from hopgraph.operators.predict import adjacency_override
from hopgraph.operators.traverse import cached_components, landmark_table
from hopgraph.plans.scratch import Scratch


def fit_initial(dist: np.ndarray, dim: int) -> np.ndarray:
    """Low-rank fit X X' ~ D of the small landmark matrix; negative directions are cut."""
    values, vectors = np.linalg.eigh((dist + dist.T) / 2.0)
    top = np.argsort(values)[::-1][:dim]
    return vectors[:, top] * np.sqrt(np.clip(values[top], 0.0, None))


def solve_rows(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Least-squares coordinates for many rows of distances; nan marks a missing landmark."""
    out = np.zeros((d.shape[0], x.shape[1]))
    known = ~np.isnan(d)
    masks, which = np.unique(known, axis=0, return_inverse=True)
    which = which.reshape(-1)
    for i, mask in enumerate(masks):
        if mask.any():
            rows = which == i
            out[rows] = d[rows][:, mask] @ np.linalg.pinv(x[mask]).T
    return out


class CoordinateOracle(Oracle):
    """Estimate = inner product of two coordinate vectors."""

    @classmethod
    def build(
        cls, graph: Graph, landmarks: int = 32, init_sz: int = 16, dim: int = 10, by: str = "degree", seed: int = 0
    ) -> "CoordinateOracle":
        scratch = Scratch(graph.spark, "coords")
        chosen = [r.id for r in choose_landmarks(graph, landmarks, by, 0, seed).collect()]
        spark = graph.spark
        ids = spark.createDataFrame([(v,) for v in chosen], "id bigint")
        comp = {r.id: r.comp for r in cached_components(graph).join(F.broadcast(ids), "id", "left_semi").collect()}
        vec = scratch.cut(pack(landmark_table(graph, ids), chosen))
        small = {r.id: r.dv for r in vec.filter(F.col("id").isin(chosen)).collect()}  # landmarks only
        square = np.array([small[v] for v in chosen], dtype=float)
        basis = np.zeros((len(chosen), dim))
        for c in dict.fromkeys(comp[v] for v in chosen):  # one system needs finite distances: one per component
            own = np.array([i for i, v in enumerate(chosen) if comp[v] == c])
            k = min(init_sz, len(own))
            start = fit_initial(square[np.ix_(own[:k], own[:k])], min(dim, k))
            basis[own[:k], : start.shape[1]] = start
            basis[own[k:], : start.shape[1]] = solve_rows(start, square[np.ix_(own[k:], own[:k])])

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    d = np.array([np.asarray(row, dtype=float) for row in f["dv"]])
                    yield pd.DataFrame({"id": f["id"], "v": list(solve_rows(basis, d))})

        asked = vec.select("id", F.transform("dv", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("dv"))
        coords = scratch.cut(asked.mapInPandas(place, "id bigint, v array<double>"))
        # a single landmark spans no system: its component is answered through the home
        many = [v for v in chosen if sum(comp[x] == comp[v] for x in chosen) > 1]
        placed = cached_components(graph).filter(F.col("comp").isin([comp[v] for v in many])).select("id")
        coords = coords.join(placed, "id", "left_semi")
        return cls({"coords": coords, "home": home_table(graph)}, {"landmarks": chosen, "dim": dim})

    def query(self, pairs: DataFrame) -> DataFrame:
        ends = attach(pairs.select("src", "dst").distinct(), self.tables["coords"], "v")
        est = ends.select("src", "dst", dot(F.col("v_s"), F.col("v_d")).alias("est"))
        return answer_all(est, self.tables["home"])


class AdjacentExactOracle(CoordinateOracle):
    """The same coordinates, exact for equal and adjacent nodes."""

    @classmethod
    def build(cls, graph: Graph, **settings) -> "AdjacentExactOracle":
        base = CoordinateOracle.build(graph, **settings)
        return cls({**base.tables, "arcs": graph.arcs}, base.settings)

    def query(self, pairs: DataFrame) -> DataFrame:
        return adjacency_override(super().query(pairs), self.tables["arcs"], "est")

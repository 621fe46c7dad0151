"""Pair and sample generation.

"Random" always means an order by a seeded hash, so each sample can be
regenerated.  Destinations are drawn by dense number instead of by sorting all
nodes per source: ``k`` draws cost ``k`` join rows per source.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h, h2, wide
from hopgraph.operators.graph import Graph
from hopgraph.operators.shape import top_degree
from hopgraph.operators.traverse import landmark_table, pair_distances
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch


def draw_partners(sources: DataFrame, pool: DataFrame, size: int, k: int, seed: int = 0) -> DataFrame:
    """``k`` different members of ``pool(id)`` for every row of ``sources(src)``.

    The pool is numbered in hash order; a source starts at a hashed position
    and takes every ``size // k``-th member, which cannot repeat.
    """
    k = min(k, size)
    step = size // k
    slots = number_rows(pool.select("id"), h("id", seed), "id", name="slot")
    asked = sources.select("src", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    asked = asked.select("src", ((wide("src", seed + 1) + F.col("j") * step) % size).alias("slot"))
    return asked.join(slots, "slot").select("src", F.col("id").alias("dst"))


def _as_src(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("src"))


def classical_pairs(graph: Graph, k: int = 5, seed: int = 0) -> DataFrame:
    """Every node with ``k`` random destinations and the true distance."""
    drawn = draw_partners(_as_src(graph.nodes), graph.nodes, graph.n, k, seed)
    return pair_distances(graph, drawn)


def landmark_pairs(graph: Graph, landmarks: DataFrame) -> DataFrame:
    """Landmark to every node it reaches."""
    return landmark_table(graph, landmarks).select(F.col("lm").alias("src"), F.col("id").alias("dst"), "d")


def landmark_inner_pairs(graph: Graph, landmarks: DataFrame, self_pairs: bool = False) -> DataFrame:
    """Landmark to landmark; a search ends when it has met all landmarks."""
    lm = landmarks.select("id").distinct()
    every = lm.select(F.col("id").alias("src")).crossJoin(lm.select(F.col("id").alias("dst")))
    out = pair_distances(graph, every, screen=False, side="src").filter("d >= 0")
    return out if self_pairs else out.filter("src <> dst")


def half_split_pairs(graph: Graph, num: int = -1, seed: int = 0) -> DataFrame:
    """Shuffle the nodes, pair the first half with the second, add distances."""
    half = graph.n // 2
    slots = number_rows(graph.nodes.select("id"), h("id", seed), "id", name="slot")
    take = half if num < 0 else min(num, half)
    left = slots.filter(F.col("slot") < take).select("slot", F.col("id").alias("src"))
    right = slots.select((F.col("slot") - half).alias("slot"), F.col("id").alias("dst"))
    return pair_distances(graph, left.join(right, "slot").select("src", "dst"))


def landmark_split_pairs(graph: Graph, landmarks: DataFrame) -> DataFrame:
    """P5: landmark pairs flagged ``intra``, landmark to other nodes flagged ``inter``."""
    flag = landmarks.select(F.col("id").alias("dst"), F.lit("intra").alias("kind"))
    return landmark_pairs(graph, landmarks).join(flag, "dst", "left").select(
        "src", "dst", "d", F.coalesce("kind", F.lit("inter")).alias("kind")
    ).filter("src <> dst")


def capped_neighbours(graph: Graph, ids: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """``(id, nbr)``: up to ``k`` hash-picked neighbours plus the node itself.

    The ranking is first applied inside the hub blocks, so at most ``k`` rows
    per block reach the final ranking of a node.
    """
    known = graph.with_blocks(ids.select("id").distinct())
    fan = known.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
    arcs = fan.join(graph.hops.select(F.col("src").alias("id"), "blk", F.col("dst").alias("nbr")), ["id", "blk"])
    if k is not None:
        order = [h2("id", "nbr", seed), F.col("nbr")]
        arcs = arcs.withColumn("rn", F.row_number().over(W.partitionBy("id", "blk").orderBy(*order))).filter(
            F.col("rn") <= k
        )
        arcs = arcs.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(*order))).filter(
            F.col("rn") <= k
        )
    return arcs.select("id", "nbr").union(known.select("id", F.col("id").alias("nbr")))


def range_rows(
    graph: Graph, pairs: DataFrame, k: int | None = None, full_block: bool = False, seed: int = 0
) -> DataFrame:
    """Neighbourhood distances of each pair as rows ``(src, dst, a, b, d)``.

    ``a = src`` against N(dst) and ``a = dst`` against N(src); with
    ``full_block`` every member of N(src) against every member of N(dst).
    ``k`` caps the neighbours per end.
    """
    scratch = Scratch(graph.spark, "ranges")
    pairs = scratch.cut(pairs.select("src", "dst").distinct())
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    near = scratch.cut(capped_neighbours(graph, ends, k, seed))
    of_dst = near.select(F.col("id").alias("dst"), F.col("nbr").alias("b"))
    of_src = near.select(F.col("id").alias("src"), F.col("nbr").alias("a"))
    if full_block:
        want = pairs.join(of_src, "src").join(of_dst, "dst").select("src", "dst", "a", "b")
    else:
        want = pairs.join(of_dst, "dst").select("src", "dst", F.col("src").alias("a"), "b").union(
            pairs.join(of_src, "src").select("src", "dst", F.col("dst").alias("a"), F.col("a").alias("b"))
        )
    want = scratch.cut(want.distinct())
    dist = pair_distances(graph, want.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(
        F.col("src").alias("a"), F.col("dst").alias("b"), "d"
    )
    return want.join(dist, ["a", "b"]).select("src", "dst", "a", "b", "d")


def pack_ranges(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Rows to ``(src, dst, part, parts, rng array<struct<a,b,d>>)``.

    Every pair is packed into ``parts`` rows of about ``block`` cells, numbered
    from 0; a hub without a neighbour cap simply has more of them.
    """
    sizes = rows.groupBy("src", "dst").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    tagged = rows.join(sizes, ["src", "dst"]).withColumn("part", h2("a", "b", 97) % F.col("parts"))
    return tagged.groupBy("src", "dst", "part", "parts").agg(
        F.array_sort(F.collect_list(F.struct("a", "b", "d"))).alias("rng")
    )


def top_degree_ranges(
    graph: Graph, sources: int, per_source: int = 100, k: int = 20, seed: int = 0
) -> DataFrame:
    """Top-degree sources, random destinations, capped neighbourhoods."""
    src = top_degree(graph.nodes, sources)
    drawn = draw_partners(_as_src(src), graph.nodes, graph.n, per_source, seed)
    return range_rows(graph, drawn, k, seed=seed)


def packed_destinations(graph: Graph, dsts: int = 100, per_dst: int = 60, seed: int = 0) -> DataFrame:
    """Top-degree destinations, each with random sources and true distances."""
    hubs = top_degree(graph.nodes, dsts).select("id")
    drawn = draw_partners(_as_src(hubs), graph.nodes, graph.n, per_dst, seed)
    return pair_distances(graph, drawn.select(F.col("dst").alias("src"), F.col("src").alias("dst")), side="dst")


def batches(pairs: DataFrame, batch: int, key: Column, *ties: str) -> DataFrame:
    """P10: shuffled mini-batches - ``batch_id`` in the order of a hashed key."""
    numbered = number_rows(pairs, key, *ties, name="rn")
    return numbered.withColumn("batch_id", F.floor(F.col("rn") / batch)).drop("rn")


def train_pairs(table: DataFrame) -> DataFrame:
    """Landmark to reachable nodes with d >= 1."""
    return table.filter("d >= 1").select(F.col("lm").alias("src"), F.col("id").alias("dst"), "d")


def first_samples(pairs: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """The first ``size`` samples in a stated order."""
    return pairs.orderBy(*order).limit(size)


def negative_samples(pairs: DataFrame, vocab: DataFrame, size: int, neg: int = 3, seed: int = 0) -> DataFrame:
    """2 + 2*neg rows per positive pair.

    The pair in both directions keeps its value; for each end ``neg`` hashed
    vocabulary members become pairs with target 0.  ``vocab(id)`` has ``size`` rows.
    """
    slots = number_rows(vocab.select("id"), "id", name="slot")
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
            F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
        )
    )
    both = pairs.select("src", "dst", "d", ends.alias("e")).select("src", "dst", "d", "e.u", "e.v")
    picks = both.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(neg)))).withColumn(
        "slot", wide(h2("u", "v", seed) + F.col("j"), seed + 2) % size
    )
    negatives = picks.join(slots, "slot").select(F.col("u").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("target"))
    positives = both.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("d").cast("double").alias("target"))
    return positives.union(negatives)


def bundle(
    graph: Graph, landmarks: DataFrame, val_k: int = 1, test_k: int = 1, seed: int = 0, test_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """All samples of a data set in one table with a ``split`` column.

    Returns the stored samples and a table ``(split, cnt, seconds)``.
    """
    scratch = Scratch(graph.spark, "bundle")
    jobs = {
        "train": lambda: landmark_pairs(graph, landmarks),
        "landmark": lambda: landmark_inner_pairs(graph, landmarks),
        "val": lambda: classical_pairs(graph, val_k, seed + 100),
        "test": lambda: classical_pairs(graph, test_k, seed + 200),
    }
    if test_only:
        jobs = {"test": jobs["test"]}
    parts, log = [], []
    for split, job in jobs.items():
        start = time.time()
        part, n = scratch.save(job().select("src", "dst", "d").withColumn("split", F.lit(split)), split)
        parts.append(part)
        log.append((split, n, time.time() - start))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out, graph.spark.createDataFrame(log, "split string, cnt bigint, seconds double")

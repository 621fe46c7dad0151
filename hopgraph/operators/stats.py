"""Statistics and centrality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.operators import held
from hopgraph.operators.bitsearch import BitSweep, in_blocks
from hopgraph.operators.graph import Graph
from hopgraph.operators.traverse import Sweep, is_connected, landmark_table, sweep_from
from hopgraph.plans.scratch import Scratch

#: Searches that run at the same time unless the caller says otherwise.
AT_ONCE = 4096


def degree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, edges, ratio and degree summary from ``nodes(id, deg)``."""
    return nodes.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("deg") / 2).cast("bigint").alias("m"),
        F.avg("deg").alias("avg_deg"),
        F.max("deg").alias("max_deg"),
        F.min("deg").alias("min_deg"),
    ).withColumn("ratio", F.col("m") / F.col("n"))


def _bounds_from(graph: Graph, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, lo2, up2): what the searches of ``chosen(id)``, 64 in the bits of a row, say of every node."""
    blocks = scratch.cut(in_blocks(chosen.select("id").distinct(), "id"))
    sweep = BitSweep(graph, blocks.select("block", "id", F.col("bit").alias("m")))
    while sweep.sizes[-1]:
        sweep.advance()
    levels = _union([sweep.level(k).select("block", "id", "m", F.lit(k).alias("d")) for k in range(sweep.depth)])
    # a search has the eccentricity of the last level that it reaches
    reached = scratch.cut(levels.groupBy("block", "d").agg(F.bit_or("m").alias("m")))
    after = reached.select("block", (F.col("d") - 1).alias("d"), F.col("m").alias("further"))
    ended = F.col("m").bitwiseAND(F.bitwise_not(F.coalesce("further", F.lit(0).cast("long"))))
    last = reached.join(after, ["block", "d"], "left").select("block", F.col("d").alias("ecc"), ended.alias("em")).filter("em <> 0")
    held = scratch.cut(last.groupBy("block").agg(F.collect_list(F.struct("ecc", "em")).alias("held")))  # at most 64
    here = F.transform(F.filter("held", lambda x: x["em"].bitwiseAND(F.col("m")) != 0), lambda x: x["ecc"])
    met = levels.join(held, "block").select("id", "d", here.alias("ecc"))
    return met.groupBy("id").agg(
        F.max(F.greatest("d", F.array_max("ecc") - F.col("d"))).alias("lo2"),
        F.min(F.array_min("ecc") + F.col("d")).alias("up2"),
    )


def eccentricity_bounds(
    graph: Graph, batch: int = 16, growth: int = 4, at_once: int = AT_ONCE
) -> tuple[DataFrame, int, int]:
    """Bounds ``(id, lo, up)`` tight enough to fix diameter and radius, and both values.

    A search from s bounds every node v: max(d, ecc(s) - d) <= ecc(v) <= ecc(s) + d.
    Each round searches from the nodes with the largest upper and the smallest
    lower bound and then drops all nodes that can change neither extreme.
    The batch grows by ``growth`` per round up to ``at_once`` searches, so graphs
    on which the bounds stay loose need few rounds.  The graph must be connected.

    Where the graph fits into a worker, what the first round leaves open is searched there.
    """
    scratch = Scratch(graph.spark, "ecc")
    bounds = scratch.cut(
        graph.nodes.select("id", "deg", F.lit(0).alias("lo"), F.lit(2**30).alias("up"))
    )
    chosen = graph.nodes.orderBy(F.desc("deg"), "id").limit(batch).select("id")
    while True:
        seen = _bounds_from(graph, chosen, scratch)
        bounds = scratch.cut(
            bounds.join(seen, "id").select(
                "id", "deg", F.greatest("lo", "lo2").alias("lo"), F.least("up", "up2").alias("up")
            )
        )
        ext = bounds.agg(F.max("lo").alias("diam"), F.min("up").alias("rad")).first()
        loose = bounds.filter("lo < up")
        useful = loose.filter((F.col("up") > ext.diam) | (F.col("lo") < ext.rad))
        if useful.isEmpty():
            return bounds.select("id", "lo", "up"), ext.diam, ext.rad
        if held.fits(graph):
            exact = held.eccentricities(graph, useful)
            bounds = scratch.cut(
                bounds.join(exact, "id", "left").select(
                    "id", F.coalesce("ecc", "lo").alias("lo"), F.coalesce("ecc", "up").alias("up")
                )
            )
            ext = bounds.agg(F.max("lo").alias("diam"), F.min("up").alias("rad")).first()
            return bounds, ext.diam, ext.rad
        batch = min(batch * growth, max(batch, at_once))
        half = batch // 2
        # far nodes settle the diameter; central nodes give the tightest upper bounds
        far = useful.orderBy(F.desc("up"), F.desc("deg"), "id").limit(half).select("id")
        near = loose.orderBy("lo", F.desc("deg"), "id").limit(half).select("id")
        chosen = scratch.cut(far.union(near).distinct())


def diameter_radius(graph: Graph, batch: int = 16) -> DataFrame:
    """One row ``(diameter, radius)``; both -1 for a disconnected graph."""
    if is_connected(graph):
        _, diam, rad = eccentricity_bounds(graph, batch)
    else:
        diam = rad = -1
    return graph.spark.createDataFrame([(diam, rad)], "diameter int, radius int")


def _source_batches(graph: Graph, sources: DataFrame | None, at_once: int):
    """Split the sources by hash into batches of about ``at_once`` searches."""
    pool = graph.nodes.select("id") if sources is None else sources.select("id").distinct()
    count = graph.n if sources is None else pool.count()
    parts = max(1, math.ceil(count / at_once))
    for i in range(parts):
        yield pool if parts == 1 else pool.filter(h("id", 11) % parts == i)


def sp_share(graph: Graph, sources: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Share of all shortest paths (unordered pairs) that contain a node, ends included.

    With ``sources`` only the paths that start in these nodes are counted.

    Counts paths forward by the sweep and continuations backward by level, so
    the pair-by-pair-by-node join is never formed: a node lies on
    ``paths(s, v) * ahead(s, v)`` shortest paths that start in s.  A graph that fits
    into a worker is searched there, from many sources at a time.
    """
    scratch = Scratch(graph.spark, "spshare")
    parts = []
    here = held.fits(graph)
    if here:
        got = held.added(held.path_shares(graph, graph.nodes if sources is None else sources))
        parts.append(scratch.cut(got.select("id", F.col("x").alias("through"), F.col("y").alias("ended"))))
    for batch in () if here else _source_batches(graph, sources, at_once):
        sweep = sweep_from(graph, batch, carry=("paths",)).run()
        ahead = None
        for k in range(sweep.depth, -1, -1):
            if not sweep.sizes[k]:
                continue
            here = sweep.level(k)
            one = F.lit(1).cast("bigint")
            if ahead is None:
                here = here.withColumn("ahead", one)
            else:
                back = graph.expand(ahead.select("src", "id", "blks", "ahead")).groupBy(
                    "src", F.col("dst").alias("id")
                ).agg(F.sum("ahead").alias("more"))
                here = here.join(back, ["src", "id"], "left").withColumn("ahead", one + F.coalesce("more", F.lit(0)))
            ahead = scratch.cut(here.select("src", "id", "blks", "paths", "ahead"))
            on_path = F.col("paths") * (F.col("ahead") - F.when(F.col("src") == F.col("id"), F.lit(1)).otherwise(F.lit(0)))
            ended = F.when(F.col("src") == F.col("id"), F.lit(0)).otherwise(F.col("paths"))
            parts.append(scratch.cut(ahead.groupBy("id").agg(F.sum(on_path).alias("through"), F.sum(ended).alias("ended"))))
    rows = _union(parts).groupBy("id").agg(F.sum("through").alias("through"), F.sum("ended").alias("ended"))
    rows = scratch.cut(rows)
    total = rows.agg(F.sum("ended")).scalar()
    return rows.select("id", (F.col("through") / total).alias("share"))


def tree_betweenness(graph: Graph, sources: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """C4: interior visits of tree paths from every source (or the given ones).

    A node other than the root is interior to the root paths of all its proper
    tree descendants, so its score is its subtree size minus one; sizes are
    summed from the deepest level upward.  A graph that fits into a worker is searched
    there, from many sources at a time.
    """
    scratch = Scratch(graph.spark, "treebc")
    parts = [graph.nodes.select("id", F.lit(0).cast("bigint").alias("score"))]
    here = held.fits(graph)
    if here:
        got = held.added(held.tree_visits(graph, graph.nodes if sources is None else sources))
        parts.append(scratch.cut(got.select("id", F.col("x").alias("score"))))
    for batch in () if here else _source_batches(graph, sources, at_once):
        sweep = sweep_from(graph, batch, carry=("parent",)).run()
        for _, size in subtree_sizes(sweep, scratch):
            parts.append(
                scratch.cut(size.filter("src <> id").groupBy("id").agg(F.sum(F.col("size") - 1).alias("score")))
            )
    return _union(parts).groupBy("id").agg(F.sum("score").alias("score"))


def subtree_sizes(sweep: Sweep, scratch: Scratch):
    """Yield ``(level, table(src, id, parent, size))`` from the deepest level to the roots."""
    below = None
    for k in range(sweep.depth, -1, -1):
        if not sweep.sizes[k]:
            continue
        here = sweep.level(k).select("src", "id", "parent")
        one = F.lit(1).cast("bigint")
        if below is None:
            here = here.withColumn("size", one)
        else:
            kids = below.groupBy("src", F.col("parent").alias("id")).agg(F.sum("size").alias("kids"))
            here = here.join(kids, ["src", "id"], "left").select(
                "src", "id", "parent", (one + F.coalesce("kids", F.lit(0))).alias("size")
            )
        below = scratch.cut(here)
        yield k, below


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def landmark_centrality(table: DataFrame) -> DataFrame:
    """+1 for being the landmark, +1/d otherwise; ``table(lm, id, d)``."""
    gain = F.when(F.col("d") == 0, F.lit(1.0)).otherwise(F.lit(1.0) / F.col("d"))
    return table.groupBy("id").agg(F.sum(gain).alias("score"))


def sampled_nodes(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return nodes.select("id").orderBy(h("id", seed), "id").limit(k)


def closeness_sampled(graph: Graph, k: int = 200, seed: int = 0) -> DataFrame:
    """Mean distance of each node to the sampled sources that reach it."""
    table = landmark_table(graph, sampled_nodes(graph.nodes, k, seed))
    return table.groupBy("id").agg(F.avg("d").alias("mean_d"), F.count(F.lit(1)).alias("reached"))


def normalise(scores: DataFrame, how: str = "share") -> DataFrame:
    """``share`` x/sum, ``log`` log(x+1)/sum, ``sigmoid`` sigmoid(x+1)/sum."""
    x = F.col("score")
    f = {
        "share": x,
        "log": F.log1p(x),
        "sigmoid": F.lit(1.0) / (F.lit(1.0) + F.exp(-(x + 1))),
    }[how]
    shaped = scores.select("id", f.alias("score"))
    return shaped.select("id", (F.col("score") / shaped.agg(F.sum("score")).scalar()).alias("score"))


def data_card(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """N, m, m/n and the range of a centrality divided by n."""
    spread = scores.agg((F.max("score") - F.min("score"))).scalar()
    return degree_stats(nodes).select("n", "m", "ratio", (spread / F.col("n")).alias("score_range"))


def walk_frequency(walks: DataFrame) -> DataFrame:
    """How often each node occurs in ``walks(path)``, most frequent first."""
    return (
        walks.select(F.explode("path").alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.desc("freq"), "id")
    )


def roots_by_frequency(walks: DataFrame) -> DataFrame:
    """Walk roots ordered by how often they occur in the corpus."""
    freq = walk_frequency(walks)
    return freq.join(walks.select(F.col("root").alias("id")).distinct(), "id").orderBy(F.desc("freq"), "id")


def length_histogram(pairs: DataFrame) -> DataFrame:
    """Share of every path length in ``pairs(d)``; the window runs over the few lengths."""
    per = pairs.groupBy("d").agg(F.count(F.lit(1)).alias("cnt"))
    return per.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy()))

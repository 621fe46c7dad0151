"""Many searches at once in the bits of a number.

64 searches share a block; a frontier row is (block, id, m), where bit i of ``m`` says that
search i of the block is at the node.  Levels merge by ``bit_or``, which combines before the
shuffle, and what a search has seen is taken away by ``& ~``.  Where searches overlap, a row stands
for up to 64 rows of a table with one row per search and node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.operators.graph import Graph
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch

WIDTH = 64
_COLUMNS = ("block", "id", "blks", "m")


def in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``block`` and ``bit`` (a power of two), by the rows' numbers in ``order``."""
    numbered = number_rows(rows, *order, name="_rn")
    bit = F.expr(f"shiftleft(1L, cast(_rn % {WIDTH} as int))")
    return numbered.withColumns({"block": F.expr(f"_rn div {WIDTH}"), "bit": bit}).drop("_rn")


class BitSweep:
    """Levels of the searches of ``seeds`` (block, id, m), one stored table each."""

    def __init__(self, graph: Graph, seeds: DataFrame):
        self.graph = graph
        self.scratch = Scratch(graph.spark, "bits")
        merged = seeds.groupBy("block", "id").agg(F.bit_or("m").alias("m"))
        first = graph.with_blocks(merged).select(*_COLUMNS)
        self.schema = first.schema
        self.depth = 0
        self.sizes: list[int] = []
        self.met = 0  # nodes reached, summed over the searches
        self._store(first, "d0")

    def _store(self, level: DataFrame, name: str) -> int:
        n, got = self.scratch.write(level, name, met=F.sum(F.bit_count("m").cast("long")))
        self.sizes.append(n)
        self.met += got["met"] or 0
        return n

    def level(self, k: int) -> DataFrame:
        return self.scratch.read(f"d{k}", self.schema)

    def advance(self) -> int:
        """One hop; returns the level's rows."""
        k = self.depth + 1
        none = F.lit(0).cast("long")
        found = self.graph.expand(self.level(self.depth)).select(
            "block", F.col("dst").alias("_new"), F.col("dst_blks").alias("blks"), "m", none.alias("seen")
        ).withColumnRenamed("_new", "id")
        # in an undirected graph a neighbour of level k lies on level k - 1, k or k + 1
        for j in range(max(0, self.depth - 1) if self.graph.symmetric else 0, self.depth + 1):
            found = found.union(self.level(j).select("block", "id", "blks", none, "m"))
        merged = found.groupBy("block", "id").agg(
            F.first("blks").alias("blks"), F.bit_or("m").alias("m"), F.bit_or("seen").alias("seen")
        )
        fresh = merged.withColumn("m", F.col("m").bitwiseAND(F.bitwise_not(F.col("seen")))).filter("m <> 0").select(*_COLUMNS)
        self.depth = k
        return self._store(fresh, f"d{k}")


def all_distances(graph: Graph, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(src, id, d) from every node of ``sources(id)`` to all that it reaches, within ``max_hops``.

    The last level is not expanded once all searches have met all nodes.
    """
    scratch = Scratch(graph.spark, "bits")
    blocks, count = scratch.save(in_blocks(sources.select("id").distinct(), "id"), "blocks")
    sweep = BitSweep(graph, blocks.select("block", "id", F.col("bit").alias("m")))
    while sweep.sizes[-1] and sweep.met < count * graph.n and (max_hops is None or sweep.depth < max_hops):
        sweep.advance()
    names = blocks.groupBy("block").agg(F.collect_list(F.struct("bit", F.col("id").alias("src"))).alias("held"))  # at most 64
    out = None
    for k in range(sweep.depth + 1):
        level = sweep.level(k).select("block", "id", "m", F.lit(k).alias("d"))
        out = level if out is None else out.union(level)
    met = out.join(names, "block").select(
        "id", "d", F.explode(F.filter("held", lambda x: x["bit"].bitwiseAND(F.col("m")) != 0)).alias("one")
    )
    return met.select(F.col("one.src").alias("src"), "id", "d")

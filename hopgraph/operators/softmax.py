"""Skip-gram with hierarchical softmax (E1): code table, inner vectors, training.

The output side is a binary tree over the nodes, the Huffman tree of their frequencies.
Predicting a context node is a walk down the tree: one yes/no decision per inner node on
its path.  Inner nodes have vectors of their own, apart from the nodes' vectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.vectors import dot, scale, vector_sum
from hopgraph.operators.embed import random_vectors, window_pairs
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch

#: Cells of one inner node that meet its vector in one place; further ones meet copies of it.
BLOCK = 1 << 14


def frequencies(walks: DataFrame) -> DataFrame:
    """``(id, cnt)``: how often each node stands in ``walks(path)``."""
    return walks.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))


def code_table(freq: DataFrame) -> DataFrame:
    """``(id, cnt, path array<struct<node, bit>>)``: Huffman codes of ``freq(id, cnt)``.

    ``path`` leads from the root to the leaf; inner nodes are numbered from the number of
    leaves on.  Merges are made in rounds: whatever is not heavier than the two lightest
    together is paired in order of weight, because no later pair can be lighter.  Each round
    at least doubles the smallest weight, so rounds follow the logarithm of the total.
    Equal weights stand in order of age, leaves by id.  One leaf has an empty path.
    """
    scratch = Scratch(freq.sparkSession, "codes")
    leaves, n = scratch.save(number_rows(freq.select("id", F.col("cnt").cast("bigint").alias("w")), "w", "id", name="node"), "leaves")
    if n < 2:
        return leaves.select("id", F.col("w").alias("cnt"), F.expr("cast(array() as array<struct<node: bigint, bit: int>>)").alias("path"))
    merged = _merge_rounds(leaves, n, scratch)
    paths = _paths(merged, scratch)
    return leaves.join(paths, "node").select("id", F.col("w").alias("cnt"), "path")


def _merge_rounds(leaves: DataFrame, n: int, scratch: Scratch) -> list[DataFrame]:
    """Per round ``(node, made, w, parent, bit)``: what was paired, ``made`` in which round (0: a leaf)."""
    made_of = lambda df, r: df.withColumn("made", F.lit(r))
    fresh = made_of(leaves.select("node", "w"), 0)
    pool = fresh.limit(0)
    merged, taken, inner = [], -1, n  # leaves up to weight ``taken`` are merged or in the pool
    while inner < 2 * n - 1:
        live = pool.union(fresh.filter(F.col("w") > taken))
        least = [x.w for x in live.orderBy("w", "node").select("w").limit(2).collect()]
        bound = sum(least)
        near, count = scratch.save(number_rows(live.filter(F.col("w") <= bound), "w", "node", name="rank"))
        pairs = count // 2
        r = len(merged) + 1
        links = scratch.cut(
            near.filter(F.col("rank") < 2 * pairs).select(
                "node", "made", "w", (F.floor(F.col("rank") / 2) + inner).cast("bigint").alias("parent"), (F.col("rank") % 2).cast("int").alias("bit")
            )
        )
        merged.append(links)
        new = made_of(links.groupBy(F.col("parent").alias("node")).agg(F.sum("w").alias("w")), r)
        rest = near.filter(F.col("rank") >= 2 * pairs).select("node", "w", "made")
        pool = scratch.cut(pool.filter(F.col("w") > bound).union(rest).unionByName(new))
        taken, inner = max(taken, bound), inner + pairs
    return merged


def _paths(merged: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``(node, path)`` of the leaves, from the last round back: a parent has two children, so no key is hot."""
    done: list[DataFrame] = []
    for r in range(len(merged), 0, -1):
        step = F.struct(F.col("parent").alias("node"), "bit")
        if r == len(merged):  # pairs of the last round: the root's own
            here = merged[r - 1].select("node", "made", F.array(step).alias("path"))
        else:
            above = reduce(DataFrame.union, done).filter(F.col("made") == r)
            up = above.select(F.col("node").alias("parent"), F.col("path").alias("up"))
            here = merged[r - 1].join(up, "parent").select("node", "made", F.concat("up", F.array(step)).alias("path"))
        done.append(scratch.cut(here))
    return reduce(DataFrame.union, done).filter("made = 0").select("node", "path")


def decisions(pairs: DataFrame, codes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(u, node, part, yes, no)``: decisions at inner nodes that the contexts of u ask for,
    and ``(node, parts)``.

    Contexts are counted per (u, inner node), so a training step does not grow with the
    length of the walks.  The cells of an inner node near the root, which all u share, are
    dealt to parts of about ``block``.
    """
    steps = pairs.join(codes.select(F.col("id").alias("v"), "path"), "v").select("u", "cnt", F.explode("path").alias("s"))
    count = lambda bit: F.sum(F.when(F.col("s.bit") == bit, F.col("cnt")).otherwise(0)).cast("double")
    scratch = Scratch(pairs.sparkSession, "cells")
    cells = scratch.cut(steps.groupBy("u", F.col("s.node").alias("node")).agg(count(0).alias("yes"), count(1).alias("no")))
    spread = scratch.cut(cells.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    return cells.join(spread, "node").select("u", "node", part.alias("part"), "yes", "no"), spread


def _scored(cells: DataFrame, spread: DataFrame, vectors: DataFrame, inner: DataFrame) -> DataFrame:
    """Cells with both vectors; a vector that several parts need is copied to each."""
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    copies = inner.join(spread, "node").select("node", every, F.col("v").alias("b"))
    known = cells.join(vectors.select(F.col("id").alias("u"), F.col("v").alias("a")), "u")
    return known.join(copies, ["node", "part"]).withColumn("z", dot(F.col("a"), F.col("b")))


def _soft(x: Column) -> Column:
    """log(1 + e^x) without overflow: what a decision with score -x costs."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


class SoftmaxSkipgram:
    """Input vectors ``vectors(id, v)``, inner vectors ``inner(node, v)`` and their ``codes``.

    Every step sums the gradients of all cells by node and by inner node (map-side first),
    takes their means and clips them, so the result does not depend on the partitions but
    for the order of floating additions.  A node without contexts keeps its first vector.
    """

    def __init__(self, vectors: DataFrame, inner: DataFrame, codes: DataFrame, cells: DataFrame, spread: DataFrame):
        self.vectors, self.inner, self.codes, self.cells, self.spread = vectors, inner, codes, cells, spread

    @classmethod
    def fit(
        cls, walks: DataFrame, dim: int = 16, window: int = 5, iters: int = 20, seed: int = 0, rate: float = 1.0, clip: float = 1.0, block: int = BLOCK
    ) -> "SoftmaxSkipgram":
        scratch = Scratch(walks.sparkSession, "softmax")
        codes = scratch.cut(code_table(frequencies(walks)), "codes")
        cells, spread = decisions(window_pairs(walks, window), codes, block)
        cells = scratch.cut(cells, "cells")
        vectors = scratch.cut(random_vectors(codes, dim, seed, 0.5), "in")
        zeros = F.array(*[F.lit(0.0)] * dim)
        inner = scratch.cut(codes.select(F.explode("path.node").alias("node")).distinct().select("node", zeros.alias("v")), "inner")
        for i in range(iters):
            z = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
            cell = F.col("yes") + F.col("no")
            rows = _scored(cells, spread, vectors, inner).withColumn("e", z * cell - F.col("yes")).withColumn("w", cell)
            both = F.array(
                F.struct(F.lit(True).alias("leaf"), F.col("u").alias("k"), scale(F.col("b"), F.col("e")).alias("g"), "w"),
                F.struct(F.lit(False).alias("leaf"), F.col("node").alias("k"), scale(F.col("a"), F.col("e")).alias("g"), "w"),
            )
            grads = scratch.cut(
                rows.select(F.inline(both)).groupBy("leaf", "k").agg(vector_sum("g", dim).alias("g"), F.sum("w").alias("w")), f"g{i}"
            )
            vectors = scratch.cut(_stepped(vectors, "id", grads.filter("leaf"), rate, clip), f"in{i}")
            inner = scratch.cut(_stepped(inner, "node", grads.filter("not leaf"), rate, clip), f"inner{i}")
        return cls(vectors, inner, codes, cells, spread)

    def loss(self) -> float:
        """Mean cost of a decision; log 2 before the first step."""
        z, yes, no = F.col("z"), F.col("yes"), F.col("no")
        row = _scored(self.cells, self.spread, self.vectors, self.inner).agg(
            F.sum(yes * _soft(-z) + no * _soft(z)).alias("cost"), F.sum(yes + no).alias("n")
        ).first()
        return row.cost / row.n if row.n else 0.0

    def log_probability(self, pairs: DataFrame) -> DataFrame:
        """``(u, v, lp)`` of the different ``pairs(u, v)`` of known nodes: log probability of context v at u."""
        codes = self.codes.select(F.col("id").alias("v"), "path")
        known = pairs.select("u", "v").distinct().join(codes, "v").join(
            self.vectors.select(F.col("id").alias("u"), F.col("v").alias("a")), "u"
        )
        steps = known.select("u", "v", "a", F.explode_outer("path").alias("s")).select("u", "v", "a", "s.node", "s.bit")
        part = F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = steps.join(self.spread, "node", "left").withColumn("part", part).drop("parts")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        copies = self.inner.join(self.spread, "node").select("node", every, F.col("v").alias("b"))
        z = dot(F.col("a"), F.col("b"))
        cost = F.coalesce(_soft(F.when(F.col("bit") == 0, -z).otherwise(z)), F.lit(0.0))
        return dealt.join(copies, ["node", "part"], "left").groupBy("u", "v").agg((-F.sum(cost)).alias("lp"))


def _stepped(table: DataFrame, key: str, grads: DataFrame, rate: float, clip: float) -> DataFrame:
    moved = table.join(grads.select(F.col("k").alias(key), "g", "w"), key, "left")
    mean = F.transform("g", lambda x: x / F.col("w"))
    size = F.sqrt(dot(F.col("m"), F.col("m")))
    step = F.lit(rate) * F.least(F.lit(1.0), F.lit(clip) / F.greatest(size, F.lit(1e-12)))
    return moved.withColumn("m", mean).withColumn("_step", step).select(
        key, F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda x, g: x - F.col("_step") * g)).alias("v")
    )

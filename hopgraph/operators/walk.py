"""Random walks.

One stepper serves all walk kinds.  A step proposes neighbours - from the row of
a node's neighbours, on hubs through the guide table with one join row per
proposal - and accepts the first proposal that obeys the walk's rule (rejection
sampling keeps the exact conditional distribution).  The few walks without an
accepted proposal are finished exactly by listing the neighbours of their node,
weighted by an exponential race.  All draws come from a hash of (seed, root, walk, step), so
a walk does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import draw
from hopgraph.operators.graph import BUCKET_ROWS, Graph, bucketed
from hopgraph.operators.traverse import pair_distances
from hopgraph.plans.guide import guide_table
from hopgraph.plans.scratch import Scratch

DEAD_END = 100  # fixed value: visit count given to a node where a walk got stuck
NEAR = 64  # a second-order walk carries up to this many neighbours of its last node
CHAIN = 4  # steps between stored states


@dataclass(frozen=True)
class Rule:
    """What distinguishes the walk kinds.

    ``restart``  probability to append the root instead of a neighbour (W1)
    ``p, q``     second-order weights (W2, W4)
    ``avoid``    never revisit a node (W3, W4, W6, W7)
    ``surf``     probability to stay away from the root after a step (W5)
    ``score``    weight neighbours by a node score (W6, W7)
    ``decay``    visit-count factor 2 - tanh(decay - visits) (W7)
    """

    restart: float = 0.0
    p: float = 1.0
    q: float = 1.0
    avoid: bool = False
    surf: float | None = None
    score: bool = False
    decay: float | None = None

    @property
    def second_order(self) -> bool:
        return self.p != 1.0 or self.q != 1.0

    @property
    def goes_home(self) -> bool:
        return bool(self.restart) or self.surf is not None

    @property
    def always_accepts(self) -> bool:
        return not (self.avoid or self.second_order or self.decay is not None)


KINDS = {
    "uniform": Rule(),
    "pq": Rule(p=0.25, q=4.0),
    "gen": Rule(avoid=True),
    "n2v": Rule(p=1.0, q=2.0, avoid=True),
    "bfs": Rule(p=10.0, q=0.1, avoid=True),
    "surf": Rule(surf=0.98),
    "bc": Rule(avoid=True, score=True),
    "bc_decay": Rule(avoid=True, score=True, decay=1.0),
}


class Walker:
    """Walk tables of one graph; ``score(id, score)`` weights the neighbours.

    A node of one block has its neighbours in one row, so all proposals of a step and the exact
    finish are expressions on the row a walk is joined with: a step shuffles the walks, once, and
    nothing else.  Only walks that stand on a hub go through the guide table, by (hub, bucket).
    Both pick the same neighbour for the same draw.
    """

    def __init__(self, graph: Graph, score: DataFrame | None = None, log_score: bool = False):
        self.graph = graph
        self.spark = graph.spark
        scratch = Scratch(graph.spark, "walker")
        if score is None:
            self.weight = None
            arcs = graph.hops.select("src", "dst", "dst_blks", F.lit(1.0).alias("w"))
        else:
            w = F.log1p("score") if log_score else F.col("score")
            self.weight = scratch.cut(score.select(F.col("id").alias("dst"), w.cast("double").alias("w")))
            arcs = graph.hops.select("src", "dst", "dst_blks").join(self.weight, "dst", "left").withColumn(
                "w", F.coalesce("w", F.lit(0.0))
            )
        most = graph.nodes.agg(F.max("deg")).first()[0] or 0
        self.wide = most > NEAR
        self.sizes = self.slots = None
        if most > graph.hub_block:
            hubs = scratch.cut(graph.nodes.filter("blks > 1").select(F.col("id").alias("src"), F.col("deg").cast("double").alias("nb")))
            self.sizes = hubs
            table = guide_table(arcs.join(hubs.select("src"), "src", "left_semi"), "src", "dst", "w")
            self.slots = scratch.cut(table.select("src", "bucket", "dst", "dst_blks", "lo", "hi"))
            arcs = arcs.join(hubs.select("src"), "src", "left_anti")
        lists = self._lists(arcs)
        if graph.m > BUCKET_ROWS:
            self.lists = bucketed(lists, scratch, "lists", "src")
        else:
            self.lists = scratch.cut(lists)

    def _lists(self, arcs: DataFrame) -> DataFrame:
        """``(src, dsts, dst_blks)``, with a score also weights ``w`` and ends ``hi`` as in the guide table."""
        if self.weight is None:
            near = F.array_sort(F.collect_list(F.struct("dst", "dst_blks"))).alias("near")
            return arcs.groupBy("src").agg(near).select("src", F.col("near.dst").alias("dsts"), F.col("near.dst_blks").alias("dst_blks"))
        all_of = W.partitionBy("src")
        used = F.when(F.sum("w").over(all_of) > 0, F.col("w")).otherwise(F.lit(1.0))
        upto = F.sum("_w").over(all_of.orderBy("dst").rowsBetween(W.unboundedPreceding, 0))
        rows = arcs.withColumn("_w", used).withColumn("_hi", upto)
        near = F.array_sort(F.collect_list(F.struct("dst", "dst_blks", "w", "_hi"))).alias("near")
        ends = F.transform("near._hi", lambda x: x / F.element_at("near._hi", -1) * F.size("near").cast("double"))
        return rows.groupBy("src").agg(near).select(
            "src", F.col("near.dst").alias("dsts"), F.col("near.dst_blks").alias("dst_blks"), F.col("near.w").alias("w"), ends.alias("hi")
        )

    def start(self, roots: DataFrame, walks: int, rule: Rule, first: int = 0, visits: DataFrame | None = None) -> DataFrame:
        """State rows for ``walks`` walks per root of ``roots(id)``."""
        seeds = roots.select("id").distinct().join(self.graph.nodes.select("id", "blks", "deg"), "id")
        extra = []
        if rule.second_order:
            extra += [F.lit(None).cast("bigint").alias("prev"), F.lit(None).cast("array<bigint>").alias("prev_near")]
        if rule.goes_home:
            extra.append(F.col("blks").alias("root_blks"))
        if rule.decay is not None and visits is None:
            extra.append(F.lit(None).cast("array<struct<at:bigint,visits:int>>").alias("seen"))
        elif rule.decay is not None:  # as many entries as the walks of the root have nodes, at most
            held = visits.select(F.col("root").alias("id"), F.struct(F.col("id").alias("at"), "visits").alias("v"))
            seeds = seeds.join(held.groupBy("id").agg(F.collect_list("v").alias("seen")), "id", "left")
            extra.append("seen")
        wid = F.explode(F.sequence(F.lit(first), F.lit(first + walks - 1))).alias("wid")
        return seeds.select(
            F.col("id").alias("root"),
            wid,
            F.col("id").alias("cur"),
            "blks",
            F.array("id").alias("path"),
            (F.col("deg") > 0).alias("alive"),
            *extra,
        )

    def run(
        self,
        roots: DataFrame,
        walks: int,
        length: int,
        rule: Rule,
        seed: int = 0,
        tries: int = 6,
        first: int = 0,
        visits: DataFrame | None = None,
    ) -> DataFrame:
        """``(root, wid, path, stuck)`` with up to ``length`` nodes per path."""
        scratch = Scratch(self.spark, "walk")
        tries = 1 if rule.always_accepts else tries
        state = scratch.cut(self.start(roots, walks, rule, first, visits), "s0")
        split = self.slots is not None or (rule.second_order and self.wide)
        shown = ["root", "wid", "path", (~F.col("alive")).alias("stuck")]
        ended = []  # stored tables with the walks that got stuck in their steps
        for step in range(1, length):
            if not split:
                state = self._near_step(state, rule, step, seed, tries)
            else:
                near = state.filter("blks = 1") if self.slots is not None else state
                out = self._near_step(self._fill_near(near) if rule.second_order else near, rule, step, seed, tries)
                if self.slots is not None:
                    out = out.unionByName(self._hub_step(state.filter("blks > 1"), rule, step, seed, tries, scratch))
                state = out
            if split or step % CHAIN == 0 or step == length - 1:
                whole = scratch.cut(state, f"s{step}")
                if step < length - 1:
                    ended.append(whole.filter("not alive").select(*shown))
                    state = whole.filter("alive")
                else:
                    state = whole
        out = state.select(*shown)
        for part in ended:
            out = out.union(part)
        return out

    def _near_step(self, state: DataFrame, rule: Rule, step: int, seed: int, tries: int) -> DataFrame:
        """One step of walks on nodes of one block: ``_i`` is the place of the chosen neighbour."""
        rows = state.join(self.lists.withColumnRenamed("src", "cur"), "cur", "left")
        nb = F.size("dsts").cast("double")
        for a in range(tries):
            rows = rows.withColumn(f"_x{a}", draw(seed, "root", "wid", F.lit(step), F.lit(a)) * nb)
        rows = rows.select("*", *[self._place(F.col(f"_x{a}"), nb).alias(f"_i{a}") for a in range(tries)])
        offers = []
        for a in range(tries):
            dst, ok = F.get("dsts", F.col(f"_i{a}")), F.lit(True)
            if not rule.always_accepts:
                factor, top = self._factor(dst, rule, lambda d: F.array_contains("prev_near", d))
                ok = draw(seed + 1, "root", "wid", F.lit(step), F.lit(a)) * F.lit(top) < factor
            offers.append(F.when(F.col("alive") & dst.isNotNull() & ok, F.col(f"_i{a}")))
        rows = rows.withColumn("_i", F.coalesce(*offers, F.when(F.col("alive"), self._race(rule, step, seed))))
        rows = rows.withColumn("dst", F.get("dsts", F.col("_i"))).withColumn("dst_blks", F.get("dst_blks", F.col("_i")))
        return self._arrive(rows, state.columns, rule, step, seed, F.when(F.size("dsts") <= NEAR, F.col("dsts")))

    def _place(self, x: Column, nb: Column) -> Column:
        """Place of the neighbour whose part of [0, nb) holds ``x``."""
        if self.weight is None:
            at = F.floor(x).cast("int")
            end = lambda i: i.cast("double") / nb * nb  # noqa: E731 - as rounded in the guide table
            return at + (x >= end(at + 1)).cast("int") - (x < end(at)).cast("int")
        halves = [1 << p for p in range(self.graph.hub_block.bit_length() - 1, -1, -1)]
        return F.aggregate(
            F.array(*map(F.lit, halves)), F.lit(0), lambda at, n: F.when(F.get("hi", at + n - 1) <= x, at + n).otherwise(at)
        )

    def _factor(self, dst: Column, rule: Rule, near: Callable[[Column], Column]):
        """Weight factor of an offer relative to the static neighbour weight, and its bound."""
        factor, top = F.lit(1.0), 1.0
        if rule.second_order:
            factor = (
                F.when(F.col("prev").isNull(), F.lit(1.0))
                .when(dst == F.col("prev"), F.lit(1.0 / rule.p))
                .when(near(dst), F.lit(1.0))
                .otherwise(F.lit(1.0 / rule.q))
            )
            top = max(1.0, 1.0 / rule.p, 1.0 / rule.q)
        if rule.decay is not None:
            here = F.filter("seen", lambda v: v["at"] == dst)
            seen = F.coalesce(F.get(here, F.lit(0))["visits"], F.lit(0))
            factor = factor * (F.lit(2.0) - F.tanh(F.lit(rule.decay) - seen))
            top *= 3.0
        if rule.avoid:
            factor = F.when(F.array_contains("path", dst), F.lit(0.0)).otherwise(factor)
        return factor, top

    def _key(self, w: Column, factor: Column, dst: Column, step: int, seed: int) -> Column:
        """The smallest key wins; zero-score neighbours are used only when no other neighbour is left."""
        u = draw(seed + 2, "root", "wid", F.lit(step), dst)
        return -F.log(u) / F.when(w > 0, w * factor).otherwise(factor * F.lit(1e-300))

    def _race(self, rule: Rule, step: int, seed: int) -> Column:
        """Exact finish in a row: place of the allowed neighbour that wins."""

        def one(dst, i):
            factor, _ = self._factor(dst, rule, lambda d: F.array_contains("prev_near", d))
            w = F.lit(1.0) if self.weight is None else F.get("w", i)
            return F.when(factor > 0, F.struct(self._key(w, factor, dst, step, seed).alias("key"), i.alias("i")))

        return F.array_min(F.transform("dsts", one))["i"]

    def _fill_near(self, state: DataFrame) -> DataFrame:
        """Neighbours of ``prev`` among those of ``cur`` where ``prev`` had too many to be carried."""
        lacks = F.col("alive") & F.col("prev").isNotNull() & F.col("prev_near").isNull()
        arcs = self.graph.arcs.select(F.col("src").alias("prev"), "dst")
        fan = state.filter(lacks).join(self.lists.select(F.col("src").alias("cur"), "dsts"), "cur").select(
            "root", "wid", "prev", F.explode("dsts").alias("dst")
        )
        shared = fan.join(arcs, ["prev", "dst"], "left_semi").groupBy("root", "wid").agg(F.collect_list("dst").alias("_near"))
        filled = state.filter(lacks).join(shared, ["root", "wid"], "left").withColumn(
            "prev_near", F.coalesce("_near", F.array().cast("array<bigint>"))
        )
        return state.filter(~lacks).unionByName(filled.select(*state.columns))

    def _hub_step(self, state: DataFrame, rule: Rule, step: int, seed: int, tries: int, scratch: Scratch) -> DataFrame:
        """One step of walks on hubs: a join row per proposal, whatever the degree."""
        hubs = state.join(self.sizes.withColumnRenamed("src", "cur"), "cur")
        tried = hubs.filter("alive").withColumn("att", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        tried = tried.withColumn("x", draw(seed, "root", "wid", F.lit(step), "att") * F.col("nb")).withColumn("bucket", F.floor("x"))
        slots = self.slots.withColumnRenamed("src", "cur")
        offers = tried.drop("blks", "nb", "root_blks", "prev_near").join(slots, ["cur", "bucket"]).filter("x >= lo and x < hi")
        offers = self._with_near(offers, rule)
        if not rule.always_accepts:
            factor, top = self._factor(F.col("dst"), rule, lambda d: F.col("near"))
            offers = offers.filter(draw(seed + 1, "root", "wid", F.lit(step), "att") * F.lit(top) < factor)
        chosen = offers.groupBy("root", "wid").agg(F.min_by("dst", "att").alias("dst"), F.min_by("dst_blks", "att").alias("dst_blks"))
        moved = state.join(chosen, ["root", "wid"], "left")
        open_walk = F.col("alive") & F.col("dst").isNull()
        _, got = scratch.write(moved, f"m{step}", open=F.sum(open_walk.cast("int")))
        moved = scratch.read(f"m{step}", moved.schema)
        if got["open"]:
            left = moved.filter(open_walk).drop("dst", "dst_blks")
            moved = moved.filter(~open_walk).unionByName(left.join(self._exact(left, rule, step, seed), ["root", "wid"], "left"))
        return self._arrive(moved, state.columns, rule, step, seed, F.lit(None).cast("array<bigint>"))

    def _with_near(self, offers: DataFrame, rule: Rule) -> DataFrame:
        if not rule.second_order:
            return offers
        near = self.graph.arcs.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near"))
        return offers.join(near, ["prev", "dst"], "left")

    def _exact(self, stuck: DataFrame, rule: Rule, step: int, seed: int) -> DataFrame:
        """List the allowed neighbours of walks without an accepted offer and race them."""
        fan = self.graph.expand(stuck.withColumn("id", F.col("cur")))
        if rule.avoid:
            fan = fan.filter(~F.array_contains("path", F.col("dst")))
        fan = self._with_near(fan, rule)
        factor, _ = self._factor(F.col("dst"), rule, lambda d: F.col("near"))
        if self.weight is None:
            fan = fan.withColumn("w", F.lit(1.0))
        else:
            fan = fan.join(self.weight, "dst", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        fan = fan.withColumn("f", factor).filter("f > 0")
        key = self._key(F.col("w"), F.col("f"), F.col("dst"), step, seed)
        return fan.groupBy("root", "wid").agg(F.min_by("dst", key).alias("dst"), F.min_by("dst_blks", key).alias("dst_blks"))

    def _arrive(self, moved: DataFrame, columns: list[str], rule: Rule, step: int, seed: int, near: Column) -> DataFrame:
        """Append the chosen node, then apply restart or surf; ``near`` are the neighbours of ``cur``."""
        go = F.col("alive") & F.col("dst").isNotNull()
        shown = F.col("dst")
        home = F.lit(False)
        if rule.restart:
            home = draw(seed + 3, "root", "wid", F.lit(step)) < rule.restart
            shown = F.when(home, F.col("root")).otherwise(shown)
        elif rule.surf is not None:
            home = draw(seed + 3, "root", "wid", F.lit(step)) >= rule.surf
        root_blks = F.col("root_blks" if rule.goes_home else "blks")
        new = {
            "cur": F.when(go & home, F.col("root")).when(go, F.col("dst")).otherwise(F.col("cur")),
            "prev": F.when(go & ~home, F.col("cur")),
            "prev_near": F.when(go & ~home, near),
            "blks": F.when(go & home, root_blks).when(go, F.col("dst_blks")).otherwise(F.col("blks")),
            "path": F.when(go, F.concat("path", F.array(shown))).otherwise(F.col("path")),
            "alive": go,
        }
        return moved.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def walks(
    graph: Graph,
    roots: DataFrame,
    kind: str | Rule = "uniform",
    per_root: int = 10,
    length: int = 40,
    score: DataFrame | None = None,
    seed: int = 0,
    log_score: bool = False,
) -> DataFrame:
    """W1-W7 by name: ``(root, wid, path, stuck)``; ``log_score`` weighs by log(1 + score)."""
    rule = KINDS[kind] if isinstance(kind, str) else kind
    walker = Walker(graph, score if rule.score else None, log_score)
    if rule.decay is None:
        return walker.run(roots, per_root, length, rule, seed)
    return decayed_walks(walker, roots, per_root, length, rule, seed)


def decayed_walks(walker: Walker, roots: DataFrame, per_root: int, length: int, rule: Rule, seed: int = 0) -> DataFrame:
    """Walks of one root share visit counts; a round is one walk index of all roots."""
    scratch = Scratch(walker.spark, "decay")
    visits = None
    out = None
    for wid in range(per_root):
        done = scratch.cut(walker.run(roots, 1, length, rule, seed, first=wid, visits=visits), f"w{wid}")
        steps = done.select("root", "stuck", F.posexplode("path").alias("pos", "id"), F.size("path").alias("len"))
        dead = F.col("stuck") & (F.col("pos") == F.col("len") - 1)
        new = steps.filter("pos > 0 or (stuck and len = 1)").select(
            "root", "id", F.when(dead, F.lit(DEAD_END)).otherwise(F.lit(1)).alias("visits"), dead.alias("dead")
        )
        if visits is not None:
            new = new.union(visits.select("root", "id", "visits", F.lit(False)))
        # a dead end sets the count, an ordinary visit adds one
        visits = scratch.cut(
            new.groupBy("root", "id").agg(
                F.when(F.max("dead"), F.lit(DEAD_END)).otherwise(F.sum("visits")).cast("int").alias("visits")
            ),
            f"v{wid}",
        )
        out = done if out is None else out.union(done)
    return out


def distance_bounds(graph: Graph, walked: DataFrame, neighbours: bool = True) -> DataFrame:
    """``(root, id, bound)`` - upper bounds on the distance learned along the walks.

    The position in a walk bounds the distance, and a step bounds its end by one
    more than its start; bounds are carried along and across all walks of a root
    until none improves.  With ``neighbours`` the nodes next to a walk are bounded
    too, by one relaxation over the arcs.
    """
    scratch = Scratch(graph.spark, "bounds")
    seen = walked.select("root", F.posexplode("path").alias("bound", "id")).groupBy("root", "id").agg(
        F.min("bound").alias("bound")
    )
    pairs = F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))
    steps = walked.filter(F.size("path") > 1).select("root", F.inline(pairs)).filter("a <> b")
    steps = scratch.cut(steps.union(steps.select("root", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "steps")
    seen = scratch.cut(seen, "seen0")
    for r in count(1):
        offer = steps.join(seen.withColumnRenamed("id", "a"), ["root", "a"]).groupBy("root", F.col("b").alias("id")).agg(
            (F.min("bound") + 1).alias("offer")
        )
        new = seen.join(offer, ["root", "id"], "left").select(
            "root", "id", F.least("bound", "offer").alias("bound"), (F.coalesce("offer", "bound") < F.col("bound")).alias("moved")
        )
        _, got = scratch.write(new, f"seen{r}", moved=F.sum(F.col("moved").cast("long")))
        seen = scratch.read(f"seen{r}", new.schema).drop("moved")
        if not got["moved"]:
            break
    if not neighbours:
        return seen
    next_to = graph.expand(graph.with_blocks(seen)).select(
        "root", F.col("dst").alias("id"), (F.col("bound") + 1).alias("bound")
    )
    return seen.union(next_to.select("root", "id", "bound")).groupBy("root", "id").agg(F.min("bound").alias("bound"))


def resample(
    bounds: DataFrame,
    score: DataFrame | None,
    alpha: float = 0.98,
    out_walks: int = 10,
    out_len: int = 40,
    seed: int = 0,
    use_distance: bool = True,
) -> DataFrame:
    """Draw nodes with weight alpha^d * score from those seen by a root, root first.

    ``use_distance=False`` draws uniformly.  A root that saw nothing keeps walks
    of itself alone.
    """
    seen = bounds.filter("id <> root")
    weight = F.pow(F.lit(float(alpha)), F.col("bound")) if use_distance else F.lit(1.0)
    if score is not None and use_distance:
        seen = seen.join(score.select("id", "score"), "id", "left")
        weight = weight * F.coalesce("score", F.lit(0.0))
    scratch = Scratch(bounds.sparkSession, "resample")
    table = scratch.cut(guide_table(seen.select("root", "id", weight.alias("w")), "root", "id", "w"))
    roots = table.groupBy("root").agg(F.max("nb").alias("nb"))
    asks = roots.withColumn("wid", F.explode(F.sequence(F.lit(0), F.lit(out_walks - 1)))).withColumn(
        "pos", F.explode(F.sequence(F.lit(1), F.lit(out_len)))
    )
    asks = asks.withColumn("x", draw(seed, "root", "wid", "pos") * F.col("nb")).withColumn("bucket", F.floor("x"))
    got = asks.drop("nb").join(table, ["root", "bucket"]).filter("x >= lo and x < hi")
    drawn = got.groupBy("root", "wid").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("a"))
    every = bounds.select("root").distinct().withColumn("wid", F.explode(F.sequence(F.lit(0), F.lit(out_walks - 1))))
    steps = F.transform("a", lambda r: r["id"])
    return every.join(drawn, ["root", "wid"], "left").select(
        "root", "wid", F.concat(F.array("root"), F.coalesce(steps, F.array().cast("array<bigint>"))).alias("path")
    )


def star_walks(graph: Graph, roots: DataFrame, length: int) -> DataFrame:
    """The root followed by its first ``length - 1`` neighbours in id order.

    Ranked inside the hub blocks first, so a hub sends at most ``length`` rows per block.
    """
    known = graph.with_blocks(roots.select("id").distinct())
    near = known.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1))).join(
        graph.hops.select(F.col("src").alias("id"), "blk", "dst"), ["id", "blk"]
    )
    for part in (["id", "blk"], ["id"]):
        near = near.withColumn("rn", F.row_number().over(W.partitionBy(*part).orderBy("dst"))).filter(
            F.col("rn") < length
        )
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return known.join(lists, "id", "left").select(
        F.col("id").alias("root"),
        F.lit(0).alias("wid"),
        F.concat(F.array("id"), F.coalesce("nbrs", F.array().cast("array<bigint>"))).alias("path"),
    )


def profile(graph: Graph, typed: DataFrame) -> DataFrame:
    """Mean and largest distance from the root per walk type and position.

    ``typed(type, root, path)``.  Only the distances from roots to nodes of their walks are searched.
    """
    steps = typed.select("type", F.col("root").alias("src"), F.posexplode("path").alias("pos", "dst"))
    dist = pair_distances(graph, steps).filter("d >= 0")
    return steps.join(dist, ["src", "dst"]).groupBy("type", "pos").agg(
        F.avg("d").alias("avg_d"), F.max("d").alias("max_d")
    )


def profile_ratio(profiled: DataFrame, diameter: int) -> DataFrame:
    """Depth reached relative to half the diameter."""
    half = -(-diameter // 2)
    return profiled.select("type", "pos", (F.col("avg_d") / F.lit(float(half))).alias("ratio"))


def coverage(typed: DataFrame) -> DataFrame:
    """Distinct nodes seen per walk type and root."""
    return typed.select("type", "root", F.explode("path").alias("id")).groupBy("type", "root").agg(
        F.countDistinct("id").alias("nodes")
    )


def path_text(path: Column | str = "path") -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), " ")

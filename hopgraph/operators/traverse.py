"""Breadth-first traversal as level-wise joins.

A ``Sweep`` advances any number of independent searches together; a search is
identified by its key columns.  One hop is two shuffles: frontier-to-arcs join
and one aggregate that at the same time merges duplicates, keeps the wanted
attribute (smallest parent, number of paths, smallest seed) and removes nodes
seen before.  In an undirected graph a neighbour of level k lies on level
k-1, k or k+1, so only the last two levels take part; the cost of a hop
follows its frontier and not everything visited so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.operators import held
from hopgraph.operators.bitsearch import all_distances
from hopgraph.operators.graph import Graph
from hopgraph.operators.hubs import HUB_DEGREE, hub_view
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch

Hook = Callable[[DataFrame, int], DataFrame]

# attribute -> (value of a seed row, value offered to a neighbour, aggregate)
_CARRY = {
    "parent": (lambda: F.lit(None).cast("bigint"), lambda: F.col("id"), F.min),
    "paths": (lambda: F.lit(1).cast("bigint"), lambda: F.col("paths"), F.sum),
    "seed": (lambda: F.col("id"), lambda: F.col("seed"), F.min),
}


class Sweep:
    """State of a batch of searches: one stored table per level.

    ``seeds`` holds the key columns and ``id``.  ``carry`` names attributes of
    ``_CARRY``; ``fixed`` names further seed columns copied along a search (they
    must be functions of the key).
    """

    def __init__(
        self,
        graph: Graph,
        seeds: DataFrame,
        keys: tuple[str, ...] = ("src",),
        carry: tuple[str, ...] = (),
        fixed: tuple[str, ...] = (),
    ):
        self.graph = graph
        self.keys = list(keys)
        self.carry = list(carry)
        self.fixed = list(fixed)
        self.scratch = Scratch(graph.spark, "sweep")
        first = graph.with_blocks(seeds.select(*keys, *fixed, "id")).select(
            *keys, *fixed, "id", "blks", *[_CARRY[c][0]().alias(c) for c in carry]
        )
        self.schema = first.schema
        self.depth = 0
        self.sizes = [self.scratch.write(first, "d=0")]
        self.full: int | None = None  # total rows after which nothing new can appear

    def level(self, k: int) -> DataFrame:
        return self.scratch.read(f"d={k}", self.schema)

    @property
    def front(self) -> DataFrame:
        return self.level(self.depth)

    def table(self) -> DataFrame:
        """All levels: keys, id, carried attributes and ``d``."""
        cols = [*self.keys, *self.fixed, "id", *self.carry]
        schema = self.schema.jsonValue()
        schema["fields"].append({"name": "d", "type": "integer", "nullable": True, "metadata": {}})
        paths = [self.scratch.path(f"d={k}") for k in range(self.depth + 1)]
        reader = self.graph.spark.read.schema(type(self.schema).fromJson(schema))
        return reader.option("basePath", self.scratch.root).parquet(*paths).select(*cols, "d")

    def advance(self, active: Hook | None = None, refine: Hook | None = None) -> int:
        """One hop; returns the size of the new level.

        ``active`` thins the frontier before it expands, ``refine`` filters the
        newly reached rows before they are stored.
        """
        k = self.depth + 1
        start = self.front if active is None else active(self.front, k)
        found = self.graph.expand(start).select(
            *self.keys,
            *self.fixed,
            F.col("dst").alias("_new"),
            F.col("dst_blks").alias("blks"),
            *[_CARRY[c][1]().alias(c) for c in self.carry],
            F.lit(False).alias("_old"),
        ).withColumnRenamed("_new", "id")
        oldest = max(0, self.depth - 1) if self.graph.symmetric else 0
        for j in range(oldest, self.depth + 1):
            found = found.union(
                self.level(j).select(
                    *self.keys,
                    *self.fixed,
                    "id",
                    "blks",
                    *[F.lit(None).cast("bigint") for _ in self.carry],
                    F.lit(True),
                )
            )
        fresh = (
            found.groupBy(*self.keys, "id")
            .agg(
                *[F.first(c).alias(c) for c in self.fixed],
                F.first("blks").alias("blks"),
                *[_CARRY[c][2](c).alias(c) for c in self.carry],
                F.max("_old").alias("_old"),
            )
            .filter(~F.col("_old"))
            .select(*self.keys, *self.fixed, "id", "blks", *self.carry)
        )
        if refine is not None:
            fresh = refine(fresh, k)
        n = self.scratch.write(fresh, f"d={k}")
        self.depth = k
        self.sizes.append(n)
        return n

    def run(self, max_hops: int | None = None, active: Hook | None = None, refine: Hook | None = None) -> "Sweep":
        while self.sizes[-1] and (max_hops is None or self.depth < max_hops):
            if self.full is not None and sum(self.sizes) >= self.full:
                break
            self.advance(active, refine)
        return self


def seeds_of(ids: DataFrame, key: str = "src") -> DataFrame:
    """``ids(id)`` as searches keyed by their own start node."""
    return ids.select("id").distinct().withColumn(key, F.col("id"))


def distances(
    graph: Graph, sources: DataFrame, max_hops: int | None = None, carry: tuple[str, ...] = (), key: str = "src"
) -> DataFrame:
    """Hop distance from every node of ``sources(id)`` to all it reaches."""
    return sweep_from(graph, sources, carry, key).run(max_hops).table()


def sweep_from(graph: Graph, sources: DataFrame, carry: tuple[str, ...] = (), key: str = "src") -> Sweep:
    """One search per node of ``sources(id)``; done at the latest when all reached all nodes."""
    sweep = Sweep(graph, seeds_of(sources, key), (key,), carry)
    sweep.full = sweep.sizes[0] * graph.n
    return sweep


def with_unreachable(dist: DataFrame, sources: DataFrame, nodes: DataFrame, key: str = "src") -> DataFrame:
    """Dense view of one search: -1 for nodes out of reach.

    ``sources`` must be one row (the distance vector of one source); for
    batches join the wanted pairs instead.
    """
    one = sources.select("id").limit(1).scalar()
    return nodes.select(one.alias(key), "id").join(dist, [key, "id"], "left").withColumn(
        "d", F.coalesce("d", F.lit(-1))
    )


def pair_distances(
    graph: Graph,
    pairs: DataFrame,
    max_hops: int | None = None,
    screen: bool = True,
    side: str | None = None,
    hub_degree: int = HUB_DEGREE,
) -> DataFrame:
    """Exact distance of every distinct ``(src, dst)``, -1 if unreachable.

    All end points search at the same time and a pair is settled when its two
    balls touch, so a search never goes deeper than half the distance.  After
    round k the meeting level gives 2k-1 or 2k.  Searches without open pairs
    stop.  ``screen`` compares component labels first, which saves the
    exhaustive search of pairs that cannot meet.  ``side`` ("src" or "dst") asks
    for full searches from that side alone, which is cheaper where it has few
    different nodes.

    Searches do not enter hubs (``hub_degree`` neighbours or more): a way by a hub is known
    from the hubs' distances.  It bounds the distance from above, and a pair is settled as
    soon as no shorter way is left, often before any search.

    A graph that fits into a worker is searched there (``held``), unless a side is named.
    """
    scratch = Scratch(graph.spark, "pairs")
    wanted = scratch.cut(pairs.select("src", "dst").distinct(), "wanted")
    if side is None and held.fits(graph, wanted):
        return scratch.cut(held.pair_distances(graph, wanted, max_hops))
    if not graph.symmetric:
        return _one_sided(graph, wanted, scratch, max_hops)
    same = wanted.filter("src = dst").join(
        graph.nodes.select(F.col("id").alias("src")), "src", "left_semi"
    ).select("src", "dst", F.lit(0).alias("d"))
    schema = same.schema
    scratch.write(same, "hit0")
    hits = ["hit0"]
    differ = wanted.filter("src <> dst")
    if screen:
        differ = connected(graph, differ)
    open_pairs, left = scratch.save(differ, "open0")
    if left and side is not None:
        a, b = ("dst", "src") if side == "dst" else ("src", "dst")
        asked = open_pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        hit = search_targets(graph, asked, max_hops=max_hops).table().select(F.col("src").alias(a), F.col("id").alias(b), "d")
        met = open_pairs.join(hit, ["src", "dst"]).select("src", "dst", "d").union(scratch.read("hit0", schema))
        return wanted.join(met, ["src", "dst"], "left").select("src", "dst", F.coalesce("d", F.lit(-1)).alias("d"))
    view = hub_view(graph, hub_degree) if left else None
    rest: Graph | None = graph
    if view is None:
        open_pairs = open_pairs.withColumn("up", F.lit(None).cast("int"))
    else:
        # different nodes are one hop apart at least, and further if a hub tells so
        settled = F.coalesce(F.col("up") <= F.greatest("low", F.lit(1)), F.lit(False))
        open_pairs, left = _settle(view.bounds(open_pairs), settled, F.col("up"), scratch, "hubs")
        hits.append("hubs")
        rest = view.rest
    if left and rest is not None:
        ends = open_pairs.select(F.explode(F.array("src", "dst")).alias("id"))
        sweep = Sweep(rest, seeds_of(ends, "root"), ("root",))
        while left and sweep.sizes[-1] and (max_hops is None or 2 * sweep.depth < max_hops):
            roots = open_pairs.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
            sweep.advance(active=lambda f, k: f.join(roots, "root", "left_semi"))
            k = sweep.depth
            a = sweep.level(k).select(F.col("root").alias("src"), "id")
            near = (
                sweep.level(k - 1)
                .select("root", "id", F.lit(2 * k - 1).alias("d"))
                .union(sweep.level(k).select("root", "id", F.lit(2 * k)))
                .select(F.col("root").alias("dst"), "id", "d")
            )
            met = (
                open_pairs.join(a, "src").join(near, ["dst", "id"]).groupBy("src", "dst").agg(F.min("d").alias("met"))
            )
            # a pair stays open only while both of its searches still grow and a way by a hub can be beaten
            alive = sweep.level(k).select("root").distinct()
            status = (
                open_pairs.join(met, ["src", "dst"], "left")
                .join(alive.select(F.col("root").alias("src"), F.lit(True).alias("s")), "src", "left")
                .join(alive.select(F.col("root").alias("dst"), F.lit(True).alias("t")), "dst", "left")
            )
            done = F.col("met").isNotNull() | F.col("s").isNull() | F.col("t").isNull()
            done = done | F.coalesce(F.col("up") <= 2 * k + 1, F.lit(False))
            open_pairs, left = _settle(status, done, F.least("met", "up"), scratch, f"hit{k}")
            hits.append(f"hit{k}")
    if left:
        scratch.write(open_pairs.select("src", "dst", F.col("up").alias("d")), "rest")
        hits.append("rest")
    found = scratch.read_many(hits, schema).filter("d is not null")
    if max_hops is not None:
        found = found.filter(F.col("d") <= max_hops)
    return wanted.join(found, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("d", F.lit(-1)).alias("d")
    )


def connected(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose ends lie in one component."""
    comp = cached_components(graph)
    return (
        pairs.join(comp.select(F.col("id").alias("src"), F.col("comp").alias("_a")), "src")
        .join(comp.select(F.col("id").alias("dst"), F.col("comp").alias("_b")), "dst")
        .filter("_a = _b")
        .select("src", "dst")
    )


def _settle(status: DataFrame, done: Column, d: Column, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Store ``status`` with the distance of its settled pairs; return the others and their number."""
    kept = status.select("src", "dst", F.when(done, d).alias("d"), "up", (~done).alias("open"))
    _, got = scratch.write(kept, name, left=F.sum(F.col("open").cast("int")))
    return scratch.read(name, kept.schema).filter("open").select("src", "dst", "up"), got["left"] or 0


def _one_sided(graph: Graph, wanted: DataFrame, scratch: Scratch, max_hops: int | None) -> DataFrame:
    sweep = search_targets(graph, wanted, max_hops=max_hops)
    hit = sweep.table().select("src", F.col("id").alias("dst"), "d")
    return wanted.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("d", F.lit(-1)).alias("d"))


def search_targets(
    graph: Graph, pairs: DataFrame, carry: tuple[str, ...] = (), max_hops: int | None = None
) -> Sweep:
    """Search from each source until all its targets are met.

    Finished sources leave the frontier after every hop.
    """
    scratch = Scratch(graph.spark, "targets")
    open_pairs, left = scratch.save(pairs.select("src", F.col("dst").alias("id")).distinct(), "open0")
    sweep = Sweep(graph, seeds_of(open_pairs.select(F.col("src").alias("id"))), ("src",), carry)
    while True:
        k = sweep.depth
        open_pairs, left = scratch.save(
            open_pairs.join(sweep.level(k), ["src", "id"], "left_anti"), f"open{k + 1}"
        )
        if not left or not sweep.sizes[-1] or (max_hops is not None and k >= max_hops):
            return sweep
        todo = open_pairs.select("src").distinct()
        sweep.advance(active=lambda f, _: f.join(todo, "src", "left_semi"))


def source_to_targets(graph: Graph, pairs: DataFrame) -> DataFrame:
    """T3 as a table ``(src, dst, d)``; -1 where the target is out of reach."""
    wanted = pairs.select("src", "dst").distinct()
    hit = search_targets(graph, wanted).table().select("src", F.col("id").alias("dst"), "d")
    return wanted.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("d", F.lit(-1)).alias("d"))


def trace(sweep: Sweep, ends: DataFrame, cut_every: int = 8) -> DataFrame:
    """Walk parents back from ``ends(keys, id)`` to the seed.

    One join per level, deepest first; a path joins in when its own end level
    is reached.  Returns keys, id, ``d`` and ``path`` (seed first).
    """
    keys = sweep.keys
    state = ends.select(*keys, "id").distinct().join(
        sweep.table().select(*keys, "id", "d"), [*keys, "id"]
    ).withColumn("cur", F.col("id")).withColumn("at", F.col("d")).withColumn("path", F.array("id"))
    for k in range(sweep.depth, 0, -1):
        if not sweep.sizes[k]:
            continue
        up = sweep.level(k).select(*keys, F.col("id").alias("cur"), "parent", F.lit(k).alias("at"))
        state = state.join(up, [*keys, "cur", "at"], "left").select(
            *keys,
            "id",
            "d",
            F.coalesce("parent", "cur").alias("cur"),
            F.when(F.col("parent").isNotNull(), F.lit(k - 1)).otherwise(F.col("at")).alias("at"),
            F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"),
        )
        if k % cut_every == 0:
            state = sweep.scratch.cut(state)
    return state.select(*keys, "id", "d", "path")


def shortest_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """T4: one shortest path per ``(src, dst)``, built from smallest parents.

    Unreachable pairs come back with ``d = -1`` and a null path; no search runs for
    pairs of different components.
    """
    wanted = pairs.select("src", "dst").distinct()
    if held.fits(graph, wanted):
        got = Scratch(graph.spark, "paths").cut(held.shortest_paths(graph, wanted))
    else:
        near = Scratch(graph.spark, "near").cut(connected(graph, wanted))
        sweep = search_targets(graph, near, carry=("parent",))
        got = trace(sweep, near.withColumnRenamed("dst", "id")).withColumnRenamed("id", "dst")
    return wanted.join(got, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("d", F.lit(-1)).alias("d"), "path"
    )


def layered_targets(
    graph: Graph, src: DataFrame, depth: int, total: int | None = 20, per_layer: int | None = None, seed: int = 0
) -> DataFrame:
    """T5: hash-sampled nodes within ``depth`` hops of one source.

    Either ``per_layer`` nodes of each layer or ``total`` nodes overall.
    """
    dist = distances(graph, src, max_hops=depth).filter("d > 0")
    if per_layer is None:
        return dist.orderBy(h("id", seed), "id").limit(total).select("src", "id", "d")
    w = F.row_number().over(W.partitionBy("src", "d").orderBy(h("id", seed), "id"))
    return dist.withColumn("rn", w).filter(F.col("rn") <= per_layer).select("src", "id", "d")


def nearest_seed(graph: Graph, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(id, seed, d)`` - nearest seed of every node, smallest seed on ties."""
    start = seeds.select("id").distinct().withColumn("g", F.lit(0))
    sweep = Sweep(graph, start, ("g",), ("seed",))
    sweep.full = graph.n
    return sweep.run(max_hops).table().select("id", "seed", "d")


def landmark_table(graph: Graph, landmarks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(lm, id, d)`` from all landmarks in one loop; without ``carry`` 64 landmarks share a row."""
    if not carry:
        return all_distances(graph, landmarks).withColumnRenamed("src", "lm")
    return distances(graph, landmarks, carry=carry, key="lm")


def all_pairs(graph: Graph) -> DataFrame:
    """Every reachable ordered pair, up to n^2 rows; 64 searches share the rows of a level.

    What only aggregates this table (diameter, betweenness, scores by distance)
    has forms that start from stated sources.
    """
    return all_distances(graph, graph.nodes)


def path_counts(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(src, id, d, paths)`` - number of shortest paths, summed hop by hop."""
    return distances(graph, sources, carry=("paths",))


def enumerate_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """All shortest paths of the given pairs, one row per path.

    No search runs for pairs of different components.
    """
    if held.fits(graph, pairs.select("src", "dst")):
        ways = held.enumerate_paths(graph, pairs.select("src", "dst").distinct())
        return Scratch(graph.spark, "paths").cut(ways.select("src", "dst", "path"))
    wanted = Scratch(graph.spark, "near").cut(connected(graph, pairs.select("src", "dst").distinct()))
    sweep = search_targets(graph, wanted)
    table = sweep.table()
    state = wanted.join(table.withColumnRenamed("id", "dst"), ["src", "dst"]).select(
        "src", "dst", F.col("d").alias("at"), F.col("dst").alias("cur"), F.array("dst").alias("path")
    )
    done = state.filter("at = 0").select("src", "dst", "path")
    state = state.filter("at > 0")
    for k in range(sweep.depth, 0, -1):
        if not sweep.sizes[k]:
            continue
        here = graph.with_blocks(state.filter(F.col("at") == k).withColumnRenamed("cur", "id"))
        back = _step_back(graph, here)
        up = sweep.level(k - 1).select("src", F.col("id").alias("cur"))
        moved = back.join(up, ["src", "cur"]).select(
            "src", "dst", F.lit(k - 1).alias("at"), "cur", F.concat(F.array("cur"), "path").alias("path")
        )
        state = sweep.scratch.cut(state.filter(F.col("at") < k).unionByName(moved))
        done = done.union(state.filter("at = 0").select("src", "dst", "path"))
        state = state.filter("at > 0")
    return done


def _step_back(graph: Graph, here: DataFrame) -> DataFrame:
    moved = graph.expand(here.withColumnRenamed("dst", "goal"))
    return moved.select("src", F.col("goal").alias("dst"), "path", F.col("dst").alias("cur"))


def connecting_subgraph(graph: Graph, chosen: DataFrame) -> DataFrame:
    """Union of shortest paths among ``chosen(id)``, as undirected edges.

    Each chosen node searches until it met all smaller chosen ones; then only
    the tree rows on the way to a chosen node are kept, level by level.
    """
    chosen = chosen.select("id").distinct()
    scratch = Scratch(graph.spark, "connect")
    sweep = Sweep(graph, seeds_of(chosen), ("src",), ("parent",))
    todo, left = scratch.save(
        number_rows(chosen, "id", name="need").select(F.col("id").alias("src"), "need").filter("need > 0"), "todo0"
    )
    while left and sweep.sizes[-1]:
        sweep.advance(active=lambda f, _: f.join(todo, "src", "left_semi"))
        met = sweep.front.join(chosen, "id", "left_semi").filter("src > id").groupBy("src").count()
        todo, left = scratch.save(
            todo.join(met, "src", "left")
            .select("src", (F.col("need") - F.coalesce("count", F.lit(0))).alias("need"))
            .filter("need > 0"),
            f"todo{sweep.depth}",
        )
    names = []
    need = None
    for k in range(sweep.depth, 0, -1):
        if not sweep.sizes[k]:
            continue
        ends = sweep.level(k).select("src", "id").join(chosen, "id", "left_semi").filter("src > id").select("src", "id")
        need = ends if need is None else ends.union(need).distinct()
        used, _ = scratch.save(
            sweep.level(k).join(need, ["src", "id"], "left_semi").select("src", "id", "parent"), f"k{k}"
        )
        names.append(used)
        need = used.select("src", F.col("parent").alias("id")).distinct()
    if not names:
        return graph.edges.limit(0)
    rows = names[0]
    for other in names[1:]:
        rows = rows.union(other)
    return rows.select(
        F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")
    ).distinct()


def arc_kinds(graph: Graph, landmarks: DataFrame) -> DataFrame:
    """Arcs ``nbr -> cur`` per landmark: 0 tree arc, 1 same level, 2 otherwise."""
    tree = landmark_table(graph, landmarks, carry=("parent",))
    start = tree.select("lm", "id", F.col("d").alias("_dn"))
    end = tree.select("lm", F.col("id").alias("dst"), F.col("d").alias("_dc"), F.col("parent").alias("_pc"))
    arcs = graph.expand(graph.with_blocks(start))
    kind = (
        F.when(F.col("_pc") == F.col("id"), F.lit(0)).when(F.col("_dn") == F.col("_dc"), F.lit(1)).otherwise(F.lit(2))
    )
    return arcs.join(end, ["lm", "dst"]).select(
        F.col("id").alias("nbr"), F.col("dst").alias("cur"), "lm", kind.alias("kind")
    )


def components(graph: Graph, jumps: int = 3) -> DataFrame:
    """``(id, comp)`` with the smallest node id of each component.

    Contraction rounds: every node points to the neighbour (or itself) with the
    smallest hash, pointers are shortened by a few jumps, and the arcs are
    rewritten to the new ends, de-duplicated and stripped of loops.  The hash
    order makes a constant share of the nodes disappear per round whatever the
    ids look like, so arcs shrink geometrically.
    """
    scratch = Scratch(graph.spark, "components")
    arcs, m = graph.arcs, graph.m
    if not graph.symmetric:
        arcs = arcs.union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    maps: list[DataFrame] = []
    while m:
        # xxhash64 of one bigint is a bijection, so ranks never tie
        salt = F.lit(len(maps))
        best = arcs.groupBy("src").agg(
            F.min(F.xxhash64(salt, "dst")).alias("x"),
            F.min_by("dst", F.xxhash64(salt, "dst")).alias("nbr"),
        )
        point = scratch.cut(
            best.select(
                F.col("src").alias("id"),
                F.when(F.col("x") < F.xxhash64(salt, "src"), F.col("nbr")).otherwise(F.col("src")).alias("to"),
            )
        )
        far = point
        for _ in range(jumps):
            nxt = point.select(F.col("id").alias("to"), F.col("to").alias("_far"))
            far = far.join(nxt, "to").select("id", F.col("_far").alias("to"))
        point = scratch.cut(far)
        maps.append(point)
        a = point.select(F.col("id").alias("src"), F.col("to").alias("_s"))
        b = point.select(F.col("id").alias("dst"), F.col("to").alias("_d"))
        arcs, m = scratch.save(
            arcs.join(a, "src").join(b, "dst").filter("_s <> _d")
            .select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct()
        )
    root = None
    for point in maps:
        if root is None:
            root = point.select("id", F.col("to").alias("root"))
        else:
            up = point.select(F.col("id").alias("root"), F.col("to").alias("_r"))
            root = root.join(up, "root", "left").select("id", F.coalesce("_r", "root").alias("root"))
    if root is None:
        return graph.nodes.select("id", F.col("id").alias("comp"))
    root = scratch.cut(root)
    names = root.groupBy("root").agg(F.min("id").alias("comp"))
    labelled = root.join(names, "root").select("id", "comp")
    return graph.nodes.select("id").join(labelled, "id", "left").select(
        "id", F.coalesce("comp", "id").alias("comp")
    )


def cached_components(graph: Graph) -> DataFrame:
    """Component labels, stored with the graph on first use."""
    if graph.comp is None:
        graph.comp = Scratch(graph.spark, "comp").cut(components(graph))
    return graph.comp


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def is_connected(graph: Graph) -> bool:
    """Fast exit: one search from one node must reach all of them."""
    one = graph.nodes.select("id").limit(1)
    return sum(Sweep(graph, seeds_of(one)).run().sizes) == graph.n

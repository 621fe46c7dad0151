"""Graph shaping: raw edges to simple symmetric graphs, subgraphs, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch


def symmetrise(arcs: DataFrame) -> DataFrame:
    """G1: both directions of every arc, once each.

    Direction is folded before the distinct, so duplicates of either
    orientation are removed by one shuffle of single-direction rows.
    """
    once = simple_edges(arcs, keep_loops=True)
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    return once.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def collapse(arcs: DataFrame) -> DataFrame:
    """Drop repeated arcs."""
    return arcs.select("src", "dst").distinct()


def drop_loops(arcs: DataFrame) -> DataFrame:
    """Drop self loops."""
    return arcs.filter(F.col("src") != F.col("dst"))


def has_loops(arcs: DataFrame) -> bool:
    return not arcs.filter(F.col("src") == F.col("dst")).isEmpty()


def simple_edges(arcs: DataFrame, keep_loops: bool = False) -> DataFrame:
    """One row (smaller id first) per undirected edge."""
    src = arcs if keep_loops else drop_loops(arcs)
    return src.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()


def clean(arcs: DataFrame) -> DataFrame:
    """Simple symmetric arcs from any raw arc table."""
    return symmetrise(drop_loops(arcs))


def first_seen(raw: DataFrame, *pos: str) -> DataFrame:
    """``(orig, at)``: earliest position of each id; within a line ``src`` comes first."""
    ends = F.explode(
        F.array(
            F.struct(F.lit(0).alias("end"), F.col("src").alias("orig")),
            F.struct(F.lit(1).alias("end"), F.col("dst").alias("orig")),
        )
    )
    seen = raw.select(*pos, ends.alias("e")).select(F.struct(*pos, "e.end").alias("at"), "e.orig")
    return seen.groupBy("orig").agg(F.min("at").alias("at"))


def relabel(raw: DataFrame, *pos: str) -> tuple[DataFrame, DataFrame]:
    """Dense ids in first-seen order.

    ``raw(src, dst, *pos)`` where ``pos`` orders the input lines.  Returns the
    relabelled arcs and the dictionary ``nodes(id, orig)``.
    """
    nodes = number_rows(first_seen(raw, *pos), "at", name="id").select("id", "orig")
    return apply_labels(raw, nodes), nodes


def apply_labels(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Translate arc ends with an existing dictionary ``nodes(id, orig)``."""
    a = nodes.select(F.col("orig").alias("src"), F.col("id").alias("_s"))
    b = nodes.select(F.col("orig").alias("dst"), F.col("id").alias("_d"))
    return raw.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def drop_isolated(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Nodes that touch at least one arc."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_semi")


def isolated(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def induced(arcs: DataFrame, keep: DataFrame) -> DataFrame:
    """Arcs with both ends in ``keep(id)``."""
    return arcs.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(
        keep.select(F.col("id").alias("dst")), "dst", "left_semi"
    ).select("src", "dst")


def degrees(arcs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, deg_out, deg_in, deg)``, zeros for nodes without arcs."""
    ends = arcs.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    if nodes is not None:
        ends = ends.union(nodes.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(
        F.sum("o").alias("deg_out"), F.sum("i").alias("deg_in"), F.sum(F.col("o") + F.col("i")).alias("deg")
    )


def top_degree(nodes: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """``k`` nodes by degree, ties by id.  ``nodes(id, deg)``; plans as a distributed top-k."""
    order = F.desc("deg") if largest else F.asc("deg")
    return nodes.select("id", "deg").orderBy(order, "id").limit(k)


def closed_neighbours(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Successors, predecessors and the node itself, as rows ``(id, nbr)``."""
    return (
        arcs.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
        .union(arcs.select("dst", "src"))
        .union(nodes.select("id", F.col("id").alias("nbr")))
        .distinct()
    )


def has_edge(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Flag ``is_edge`` for each ``(src, dst)``."""
    hit = arcs.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(hit, ["src", "dst"], "left").withColumn(
        "is_edge", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def counts(arcs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, undirected edges and their ratio in one pass over the arcs."""
    deg = degrees(arcs, nodes)
    return deg.agg(
        F.count(F.lit(1)).alias("n"), (F.sum("deg") / 4).cast("bigint").alias("m")
    ).withColumn("ratio", F.col("m") / F.col("n"))


def to_adjacency(arcs: DataFrame, nodes: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """Arcs to ``adj(id, part, parts, nbrs)`` with sorted neighbour arrays.

    A node above ``block`` neighbours is stored in several rows (``part``
    chosen by a hash of the neighbour), so no row and no task holds all
    neighbours of a hub.  ``nodes(id, deg)`` saves the degree count.
    """
    deg = nodes if nodes is not None else arcs.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("deg")
    )
    hubs = deg.filter(F.col("deg") > block).select(
        F.col("id").alias("src"), F.ceil(F.col("deg") / F.lit(block)).cast("int").alias("parts")
    )
    tagged = arcs.join(hubs, "src", "left").select(
        F.col("src").alias("id"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce(h("dst", 97) % F.col("parts"), F.lit(0)).cast("int").alias("part"),
        "dst",
    )
    return tagged.groupBy("id", "part", "parts").agg(
        F.array_sort(F.collect_list("dst")).alias("nbrs")
    )


def from_adjacency(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def asymmetric(arcs: DataFrame) -> DataFrame:
    """Arcs whose reverse is missing."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return arcs.select("src", "dst").join(back, ["src", "dst"], "left_anti")


def connect_components(edges: DataFrame, comp: DataFrame, seed: int = 0) -> DataFrame:
    """Add one edge from each smaller component to the largest one.

    ``comp(id, comp)``.  The end points are the nodes with the smallest seeded
    hash; every component picks its own target inside the largest one by a
    dense number, so no component's members are gathered.
    """
    spark = comp.sparkSession
    sizes = Scratch(spark, "connect").cut(
        comp.groupBy("comp").agg(
            F.count(F.lit(1)).alias("size"),
            F.min_by("id", F.struct(h("id", seed), F.col("id"))).alias("pick"),
        )
    )
    big = sizes.orderBy(F.desc("size"), "comp").limit(1)
    big_id = big.select("comp").scalar()
    small = sizes.filter(F.col("comp") != big_id).select(
        F.col("pick").alias("src"), (h("comp", seed + 1) % big.select("size").scalar()).alias("slot")
    )
    members = comp.filter(F.col("comp") == big_id).select("id")
    slots = number_rows(members, h("id", seed + 2), "id", name="slot")
    links = small.join(slots, "slot").select("src", F.col("id").alias("dst"))
    return edges.select("src", "dst").union(links)


def prepare(raw: DataFrame, *pos: str, drop_isolated_nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Simplify, symmetrise, drop isolated nodes, relabel; ``(arcs, nodes)``.

    A node seen only in self loops is isolated; ``drop_isolated_nodes=False``
    keeps it in the dictionary.
    """
    simple = clean(raw)
    order = first_seen(raw, *pos)
    if drop_isolated_nodes:
        order = order.join(simple.select(F.col("src").alias("orig")), "orig", "left_semi")
    nodes = number_rows(order, "at", name="id").select("id", "orig")
    return apply_labels(simple, nodes), nodes

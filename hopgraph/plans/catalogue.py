"""Registered queries: every operator on whole driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h, h_sql, wide_sql
from hopgraph.operators import evaluate as V
from hopgraph.operators import sample as P
from hopgraph.operators import shape as G
from hopgraph.operators import stats as C
from hopgraph.operators import traverse as T
from hopgraph.operators.oracles.ado import ApproxOracle
from hopgraph.operators.oracles.labels import LabelOracle, node_order, sampled_tree_order
from hopgraph.operators.oracles.landmark import LandmarkOracle, choose_landmarks
from hopgraph.plans import graphs
from hopgraph.plans import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _text(col: str, sep: str = "-"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def _top(g, k):
    return G.top_degree(g.nodes, k).select("id")


APSP = [S.bfs("nodes")]
COMP = """cc(id, comp) using key (id) as (
  select id, id from nodes
  union
  select a.dst, min(c.comp) from cc c join arcs a on a.src = c.id join recurring.cc r on r.id = a.dst
  where c.comp < r.comp group by a.dst)"""


# ------------------------------------------------------------------ shaping (G)
@register("edges_simple", S.query(S.graph("supply"), "select src, dst from arcs"))
def edges_simple(spark, sf):
    return G.clean(graphs.raw(spark, sf, "supply"))


@register("edges_undirected_once", S.query(S.graph("supply"), "select a as src, b as dst from e"))
def edges_undirected_once(spark, sf):
    return G.simple_edges(graphs.raw(spark, sf, "supply"))


@register(
    "collapsed_arcs",
    S.query(S.graph("follow"), "select distinct src, dst, src = dst as is_loop from raw"),
)
def collapsed_arcs(spark, sf):
    return G.collapse(graphs.raw(spark, sf, "follow")).withColumn("is_loop", F.col("src") == F.col("dst"))


@register(
    "relabel_dense",
    """with ends as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 as e, l_suppkey * 2 as orig from lineitem
  union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, l_partkey * 2 + 1 from lineitem),
first as (select orig, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey, e)) as pos from ends group by orig)
select row_number() over (order by pos) - 1 as id, orig from first""",
)
def relabel_dense(spark, sf):
    pos = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = graphs.table(spark, sf, "lineitem").select(
        *pos, (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")
    )
    return G.relabel(raw, *pos)[1]


@register(
    "prepared_links",
    S.query(
        S.RAW["link"]
        + [
            "lines as (select page_id, href from named group by page_id, href)",
            """ends as (select page_id, href, 0 as e, 'p' || page_id as orig from lines
  union all select page_id, href, 1, href from lines)""",
            "first as (select orig, min(row(page_id, href, e)) as pos from ends group by orig)",
            "ids as (select orig, row_number() over (order by pos) - 1 as id from first)",
            """und as (select distinct a.id as src, b.id as dst from lines
  join ids a on a.orig = 'p' || page_id join ids b on b.orig = href where a.id <> b.id)""",
        ],
        "select src, dst from und union select dst, src from und",
    ),
)
def prepared_links(spark, sf):
    named = graphs.link_named(spark, sf).distinct().select(
        "page_id", "href", F.concat(F.lit("p"), F.col("page_id")).alias("src"), F.col("href").alias("dst")
    )
    return G.prepare(named, "page_id", "href")[0]


_BUILDING = """keep as (select o_orderkey as id from orders join customer on o_custkey = c_custkey
  where c_mktsegment = 'BUILDING' and o_orderpriority = '1-URGENT')"""
_INDUCED = "ind as (select src, dst from arcs where src in (select id from keep) and dst in (select id from keep))"


def _building(spark, sf):
    cust = graphs.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    urgent = graphs.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return urgent.join(cust, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@register("induced_subgraph", S.query(S.graph("trade") + [_BUILDING, _INDUCED], "select src, dst from ind"))
def induced_subgraph(spark, sf):
    return G.induced(graphs.graph(spark, sf, "trade").arcs, _building(spark, sf))


@register(
    "isolated_nodes",
    S.query(S.graph("trade") + [_BUILDING, _INDUCED], "select id from keep where id not in (select src from ind)"),
)
def isolated_nodes(spark, sf):
    keep = _building(spark, sf)
    return G.isolated(keep, G.induced(graphs.graph(spark, sf, "trade").arcs, keep))


@register(
    "degree_all",
    S.query(
        S.graph("trade"),
        """select o_orderkey as id, count(a.src)::bigint as deg_out, count(a.src)::bigint as deg_in, (2 * count(a.src))::bigint as deg
from orders left join arcs a on a.src = o_orderkey group by o_orderkey""",
    ),
)
def degree_all(spark, sf):
    nodes = graphs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.degrees(graphs.graph(spark, sf, "trade").arcs, nodes)


@register("degree_topk", S.query(S.graph("supply"), "select id, deg from nodes order by deg desc, id limit 20"))
def degree_topk(spark, sf):
    return G.top_degree(graphs.graph(spark, sf, "supply").nodes, 20)


@register(
    "has_edge_pairs",
    S.query(
        S.graph("trade"),
        """select o_orderkey as src, o_orderkey + 1 as dst, a.src is not null as is_edge
from orders left join arcs a on a.src = o_orderkey and a.dst = o_orderkey + 1""",
    ),
)
def has_edge_pairs(spark, sf):
    pairs = graphs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return G.has_edge(pairs, graphs.graph(spark, sf, "trade").arcs)


@register(
    "asymmetric_arcs",
    S.query(
        S.graph("follow"),
        "select distinct r.src, r.dst from raw r where not exists (select 1 from raw q where q.src = r.dst and q.dst = r.src)",
    ),
)
def asymmetric_arcs(spark, sf):
    return G.asymmetric(G.collapse(graphs.raw(spark, sf, "follow")))


@register(
    "neighbour_rows",
    S.query(
        S.graph("follow"),
        "select src as id, dst as nbr from raw union select dst, src from raw union select src, src from raw union select dst, dst from raw",
    ),
)
def neighbour_rows(spark, sf):
    arcs = graphs.raw(spark, sf, "follow")
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.closed_neighbours(arcs, nodes)


@register(
    "adjacency_lists",
    S.query(
        S.graph("supply")
        + [
            f"""tagged as (select a.src as id, a.dst, case when deg > 256 then ({h_sql('a.dst', 97)} % ceil(deg / 256.0)::bigint)::int else 0 end as part
  from arcs a join nodes n on n.id = a.src)"""
        ],
        "select id, part, array_to_string(list_sort(list(dst)), ' ') as nbrs from tagged group by id, part",
    ),
)
def adjacency_lists(spark, sf):
    adj = G.to_adjacency(graphs.graph(spark, sf, "supply").arcs, block=256)
    return adj.select("id", "part", _text("nbrs", " ").alias("nbrs"))


@register(
    "components_connected",
    S.query(
        S.graph("link")
        + [
            COMP,
            f"""sizes as (select comp, count(*) as size, arg_min(id, row({h_sql('id', 5)}, id)) as pick from cc group by comp)""",
            "big as (select comp, size from sizes order by size desc, comp limit 1)",
            f"""members as (select id, row_number() over (order by {h_sql('id', 7)}, id) - 1 as slot from cc where comp = (select comp from big))""",
            f"""links as (select pick as src, m.id as dst from sizes s join members m on m.slot = {h_sql('s.comp', 6)} % (select size from big)
  where s.comp <> (select comp from big))""",
        ],
        "select a as src, b as dst from e union all select src, dst from links",
    ),
)
def components_connected(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return G.connect_components(g.edges, T.cached_components(g), seed=5)


# ---------------------------------------------------------------- statistics (C)
@register(
    "graph_card",
    S.query(S.graph("supply"), "select count(*) as n, (sum(deg) / 2)::bigint as m, round((sum(deg) / 2) / count(*), 6) as ratio from nodes"),
)
def graph_card(spark, sf):
    return G.counts(graphs.graph(spark, sf, "supply").arcs).select("n", "m", F.round("ratio", 6).alias("ratio"))


@register(
    "degree_stats",
    S.query(
        S.graph("trade"),
        """select count(*) as n, (sum(deg) / 2)::bigint as m, round(avg(deg), 6) as avg_deg, max(deg) as max_deg, min(deg) as min_deg,
round((sum(deg) / 2) / count(*), 6) as ratio from nodes""",
    ),
)
def degree_stats(spark, sf):
    out = C.degree_stats(graphs.graph(spark, sf, "trade").nodes)
    return out.withColumn("avg_deg", F.round("avg_deg", 6)).withColumn("ratio", F.round("ratio", 6))


@register(
    "diameter_radius",
    S.query(
        S.graph("supply") + APSP + ["ecc as (select k, max(d) as x from bfs group by k)"],
        "select max(x) as diameter, min(x) as radius from ecc",
    ),
)
def diameter_radius(spark, sf):
    return C.diameter_radius(graphs.graph(spark, sf, "supply"))


@register(
    "diameter_radius_follow",
    S.query(
        S.graph("follow") + APSP + ["ecc as (select k, max(d) as x from bfs group by k)"],
        "select max(x) as diameter, min(x) as radius from ecc",
    ),
)
def diameter_radius_follow(spark, sf):
    return C.diameter_radius(graphs.graph(spark, sf, "follow"))


@register(
    "sp_share",
    S.query(
        S.graph("link")
        + APSP
        + [
            """through as (select v.id as id, sum(v.paths * w.paths) as c from bfs st
  join bfs v on v.k = st.k join bfs w on w.k = v.id and w.id = st.id and v.d + w.d = st.d where st.k < st.id group by v.id)"""
        ],
        "select id, round(c / (select sum(paths) from bfs where k < id), 9) as share from through",
    ),
)
def sp_share(spark, sf):
    return C.sp_share(graphs.graph(spark, sf, "link")).select("id", F.round("share", 9).alias("share"))


@register(
    "tree_betweenness",
    S.query(
        S.graph("link")
        + APSP
        + [
            """up(k, t, v) as (select k, id, parent from bfs where parent is not null and parent <> k
  union all select u.k, u.t, b.parent from up u join bfs b on b.k = u.k and b.id = u.v where b.parent is not null and b.parent <> u.k)"""
        ],
        "select n.id, count(u.v) as score from nodes n left join up u on u.v = n.id group by n.id",
    ),
)
def tree_betweenness(spark, sf):
    return C.tree_betweenness(graphs.graph(spark, sf, "link"))


_CENTRAL = "central as (select id, sum(case when d = 0 then 1.0::double else 1.0::double / d end) as score from bfs group by id)"


@register(
    "landmark_centrality",
    S.query(S.graph("supply") + [S.top(16), S.bfs(), _CENTRAL], "select id, round(score, 6) as score from central"),
)
def landmark_centrality(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return C.landmark_centrality(T.landmark_table(g, _top(g, 16))).select("id", F.round("score", 6).alias("score"))


@register(
    "closeness_sampled",
    S.query(
        S.graph("trade") + [f"seeds as (select id from nodes order by {h_sql('id', 3)}, id limit 64)", S.bfs()],
        "select id, round(avg(d), 6) as mean_d, count(*) as reached from bfs group by id",
    ),
)
def closeness_sampled(spark, sf):
    out = C.closeness_sampled(graphs.graph(spark, sf, "trade"), 64, seed=3)
    return out.select("id", F.round("mean_d", 6).alias("mean_d"), "reached")


@register(
    "score_normalised",
    S.query(
        S.graph("follow") + [S.top(8), S.bfs(), _CENTRAL],
        """select id, round(score / sum(score) over (), 9) as share, round(ln(1 + score) / sum(ln(1 + score)) over (), 9) as log_share,
round((1 / (1 + exp(-(score + 1)))) / sum(1 / (1 + exp(-(score + 1)))) over (), 9) as sigmoid_share from central""",
    ),
)
def score_normalised(spark, sf):
    from hopgraph.plans.scratch import Scratch

    g = graphs.graph(spark, sf, "follow")
    score = Scratch(spark, "score").cut(C.landmark_centrality(T.landmark_table(g, _top(g, 8))))
    out = score.select("id")
    for how, name in (("share", "share"), ("log", "log_share"), ("sigmoid", "sigmoid_share")):
        out = out.join(C.normalise(score, how).select("id", F.round("score", 9).alias(name)), "id")
    return out


@register(
    "data_card",
    S.query(
        S.graph("supply") + [S.top(4), S.bfs(), _CENTRAL],
        """select count(*) as n, (sum(deg) / 2)::bigint as m, round((sum(deg) / 2) / count(*), 6) as ratio,
round((select max(score) - min(score) from central) / count(*), 9) as score_range from nodes""",
    ),
)
def data_card(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    out = C.data_card(g.nodes, C.landmark_centrality(T.landmark_table(g, _top(g, 4))))
    return out.select("n", "m", F.round("ratio", 6).alias("ratio"), F.round("score_range", 9).alias("score_range"))


@register(
    "length_histogram",
    S.query(
        S.graph("trade") + [S.top(16), S.bfs()],
        "select d, count(*) as cnt, round(count(*) / sum(count(*)) over (), 6) as share from bfs where d > 0 group by d",
    ),
)
def length_histogram(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return C.length_histogram(P.train_pairs(T.landmark_table(g, _top(g, 16)))).select("d", "cnt", F.round("share", 6).alias("share"))


# ----------------------------------------------------------------- traversal (T)
@register(
    "bfs_one_source",
    S.query(
        S.graph("trade") + [S.top(1), S.bfs()],
        "select (select id from seeds) as src, n.id, coalesce(b.d, -1) as d from nodes n left join bfs b on b.id = n.id",
    ),
)
def bfs_one_source(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    src = _top(g, 1)
    return T.with_unreachable(T.distances(g, src), src, g.nodes)


@register(
    "bfs_depth_layers",
    S.query(
        S.graph("trade")
        + [
            S.top(1),
            S.bfs(extra="and b.d < 6"),
            f"""ranked as (select k, id, d, row_number() over (partition by k, d order by {h_sql('id', 9)}, id) as rn from bfs where d > 0)""",
        ],
        "select k as src, id, d from ranked where rn <= 5",
    ),
)
def bfs_depth_layers(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return T.layered_targets(g, _top(g, 1), depth=6, per_layer=5, seed=9)


@register(
    "bfs_depth_sample",
    S.query(
        S.graph("supply") + [S.top(1), S.bfs(extra="and b.d < 3")],
        f"select k as src, id, d from bfs where d > 0 order by {h_sql('id', 9)}, id limit 20",
    ),
)
def bfs_depth_sample(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return T.layered_targets(g, _top(g, 1), depth=3, total=20, seed=9)


@register(
    "pair_distance",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 20, 1) + APSP,
        "select p.src, p.dst, coalesce(b.d, -1) as d from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def pair_distance(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return T.pair_distances(g, P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, 20, 1))


@register(
    "gt_dist_query",
    S.query(
        S.graph("supply")
        + [S.top(10), f"one as (select id from seeds order by {h_sql('id', 2)}, id limit 1)"]
        + S.drawn("one", "nodes", 200, 2)
        + [S.bfs("one")],
        "select p.src, p.dst, coalesce(b.d, -1) as d from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def gt_dist_query(spark, sf):
    return V.ground_truth_query(graphs.graph(spark, sf, "supply"), targets=200, seed=2)


_PATHS = """walked(k, id, d, txt) using key (k, id) as (
  select id, id, 0, id::varchar from nodes
  union
  select b.k, a.dst, b.d + 1, arg_min(b.txt, b.id) || '-' || a.dst from walked b join arcs a on a.src = b.id
  where not exists (select 1 from recurring.walked r where r.k = b.k and r.id = a.dst) group by b.k, a.dst, b.d + 1)"""


@register(
    "shortest_path_strings",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 4, 4) + [_PATHS],
        "select p.src, p.dst, coalesce(b.d, -1) as d, b.txt as path from drawn p left join walked b on b.k = p.src and b.id = p.dst",
    ),
)
def shortest_path_strings(spark, sf):
    g = graphs.graph(spark, sf, "link")
    pairs = P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, 4, 4)
    return T.shortest_paths(g, pairs).select("src", "dst", "d", _text("path").alias("path"))


@register(
    "nearest_seed",
    S.query(
        S.graph("trade") + [S.top(100), S.bfs(), "near as (select id, min(d) as d from bfs group by id)"],
        "select b.id, min(b.k) as seed, b.d from bfs b join near n on n.id = b.id and n.d = b.d group by b.id, b.d",
    ),
)
def nearest_seed(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return T.nearest_seed(g, _top(g, 100))


@register("landmark_table", S.query(S.graph("supply") + [S.top(16), S.bfs()], "select k as lm, id, d from bfs"))
def landmark_table(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return T.landmark_table(g, _top(g, 16))


@register("all_pairs", S.query(S.graph("link") + APSP, "select k as src, id, d from bfs"))
def all_pairs(spark, sf):
    return T.all_pairs(graphs.graph(spark, sf, "link"))


@register("train_pairs", S.query(S.graph("trade") + [S.top(16), S.bfs()], "select k as src, id as dst, d from bfs where d >= 1"))
def train_pairs(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return P.train_pairs(T.landmark_table(g, _top(g, 16)))


@register("components", S.query(S.graph("trade") + [COMP], "select id, comp from cc"))
def components(spark, sf):
    return T.components(graphs.graph(spark, sf, "trade"))


@register("component_sizes", S.query(S.graph("geo") + [COMP], "select comp, count(*) as size from cc group by comp"))
def component_sizes(spark, sf):
    return T.component_sizes(T.components(graphs.graph(spark, sf, "geo")))


@register("path_counts", S.query(S.graph("supply") + [S.top(16), S.bfs()], "select k as src, id, d, paths from bfs"))
def path_counts(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return T.path_counts(g, _top(g, 16)).select("src", "id", "d", "paths")


@register(
    "all_shortest_paths",
    S.query(
        S.graph("link")
        + S.drawn("nodes", "nodes", 2, 6)
        + APSP
        + [
            """allp(k, id, d, txt) as (select id, id, 0, id::varchar from nodes
  union all select p.k, a.dst, p.d + 1, p.txt || '-' || a.dst from allp p join arcs a on a.src = p.id
  join bfs b on b.k = p.k and b.id = a.dst and b.d = p.d + 1)"""
        ],
        "select p.src, p.dst, q.txt as path from drawn p join allp q on q.k = p.src and q.id = p.dst",
    ),
)
def all_shortest_paths(spark, sf):
    g = graphs.graph(spark, sf, "link")
    pairs = P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, 2, 6)
    return T.enumerate_paths(g, pairs).select("src", "dst", _text("path").alias("path"))


@register(
    "connecting_subgraph",
    S.query(
        S.graph("link")
        + [
            S.top(12),
            S.bfs(),
            """back(k, id) as (select k, id from bfs where id in (select id from seeds) and k > id
  union select m.k, b.parent from back m join bfs b on b.k = m.k and b.id = m.id where b.parent is not null)""",
        ],
        """select distinct least(b.id, b.parent) as src, greatest(b.id, b.parent) as dst
from back m join bfs b on b.k = m.k and b.id = m.id where b.parent is not null""",
    ),
)
def connecting_subgraph(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return T.connecting_subgraph(g, _top(g, 12))


@register(
    "arc_labels",
    S.query(
        S.graph("link") + [S.top(8), S.bfs()],
        """select u.id as nbr, v.id as cur, u.k as lm, case when v.parent = u.id then 0 when u.d = v.d then 1 else 2 end as kind
from bfs u join arcs a on a.src = u.id join bfs v on v.k = u.k and v.id = a.dst""",
    ),
)
def arc_labels(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return T.arc_kinds(g, _top(g, 8))


# ------------------------------------------------------------------- samples (P)
_DIST = "coalesce(b.d, -1) as d"


def _pairs_sql(table: str) -> str:
    return f"select p.src, p.dst, {_DIST} from {table} p left join bfs b on b.k = p.src and b.id = p.dst"


@register("pairs_classical", S.query(S.graph("link") + S.drawn("nodes", "nodes", 5, 0) + APSP, _pairs_sql("drawn")))
def pairs_classical(spark, sf):
    return P.classical_pairs(graphs.graph(spark, sf, "link"), 5)


@register("pairs_landmark", S.query(S.graph("geo") + [S.top(12), S.bfs()], "select k as src, id as dst, d from bfs"))
def pairs_landmark(spark, sf):
    g = graphs.graph(spark, sf, "geo")
    return P.landmark_pairs(g, _top(g, 12))


@register(
    "pairs_landmark_inner",
    S.query(S.graph("supply") + [S.top(40), S.bfs()], "select k as src, id as dst, d from bfs where k <> id and id in (select id from seeds)"),
)
def pairs_landmark_inner(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return P.landmark_inner_pairs(g, _top(g, 40))


@register(
    "pairs_half_split",
    S.query(
        S.graph("link")
        + [
            S.slots("nodes", 8),
            "half as (select count(*) // 2 as n from nodes)",
            "zip as (select a.id as src, b.id as dst from slots a join slots b on b.slot = a.slot + (select n from half) where a.slot < (select n from half))",
        ]
        + APSP,
        _pairs_sql("zip"),
    ),
)
def pairs_half_split(spark, sf):
    return P.half_split_pairs(graphs.graph(spark, sf, "link"), seed=8)


@register(
    "pairs_intra_inter",
    S.query(
        S.graph("trade") + [S.top(24), S.bfs()],
        "select k as src, id as dst, d, case when id in (select id from seeds) then 'intra' else 'inter' end as kind from bfs where k <> id",
    ),
)
def pairs_intra_inter(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return P.landmark_split_pairs(g, _top(g, 24))


_CLOSED = "closed as (select src as id, dst as nbr from arcs union all select id, id from nodes)"


def _range_sql(near: str) -> list[str]:
    return [
        f"""want as (select p.src, p.dst, p.src as a, n.nbr as b from drawn p join {near} n on n.id = p.dst
  union select p.src, p.dst, p.dst, n.nbr from drawn p join {near} n on n.id = p.src)"""
    ]


_RANGE_BODY = "select w.src, w.dst, w.a, w.b, coalesce(x.d, -1) as d from want w left join bfs x on x.k = w.a and x.id = w.b"


@register(
    "pairs_range",
    S.query(S.graph("link") + S.drawn("nodes", "nodes", 1, 10) + [_CLOSED] + _range_sql("closed") + APSP, _RANGE_BODY),
)
def pairs_range(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return P.range_rows(g, P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, 1, 10))


def _capped_sql(k: int, seed: int) -> str:
    inner = h_sql(f"{h_sql('src', seed)} + dst", seed + 1)
    return f"""capped as (select id, nbr from (select src as id, dst as nbr, row_number() over (partition by src order by {inner}, dst) as rn from arcs)
  where rn <= {k} union all select id, id from nodes)"""


@register(
    "pairs_range_capped",
    S.query(
        S.graph("link")
        + S.drawn("nodes", "nodes", 1, 11)
        + [
            _capped_sql(4, 11),
            "want as (select distinct p.src, p.dst, u.nbr as a, v.nbr as b from drawn p join capped u on u.id = p.src join capped v on v.id = p.dst)",
        ]
        + APSP,
        _RANGE_BODY,
    ),
)
def pairs_range_capped(spark, sf):
    g = graphs.graph(spark, sf, "link")
    pairs = P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, 1, 11)
    return P.range_rows(g, pairs, k=4, full_block=True, seed=11)


@register(
    "pairs_range_top",
    S.query(
        S.graph("supply") + [S.top(8)] + S.drawn("seeds", "nodes", 10, 12) + [_capped_sql(5, 12)] + _range_sql("capped")
        + ["starts as (select distinct a as id from want)", S.bfs("starts")],
        _RANGE_BODY,
    ),
)
def pairs_range_top(spark, sf):
    return P.top_degree_ranges(graphs.graph(spark, sf, "supply"), 8, per_source=10, k=5, seed=12)


@register(
    "ranges_packed",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 1, 10) + [_CLOSED] + _range_sql("closed") + APSP
        + [f"r as ({_RANGE_BODY})"],
        """select src, dst, string_agg(a || '&' || b || '&' || d || '@', '' order by a, b) as rng,
0::bigint as part, 1::bigint as parts from r group by src, dst""",
    ),
)
def ranges_packed(spark, sf):
    packed = P.pack_ranges(pairs_range(spark, sf))
    cell = F.transform("rng", lambda r: F.concat(F.concat_ws("&", r["a"], r["b"], r["d"]), F.lit("@")))
    return packed.select("src", "dst", F.array_join(cell, "").alias("rng"), "part", "parts")


@register(
    "pairs_dst_packed",
    S.query(
        S.graph("supply") + [S.top(30)] + S.drawn("seeds", "nodes", 60, 13) + [S.bfs()],
        "select p.dst as src, p.src as dst, coalesce(b.d, -1) as d from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def pairs_dst_packed(spark, sf):
    return P.packed_destinations(graphs.graph(spark, sf, "supply"), 30, 60, seed=13)


@register(
    "batches",
    S.query(
        S.graph("trade") + [S.top(16), S.bfs()],
        f"""select k as src, id as dst, d, ((row_number() over (order by {h_sql(h_sql('k', 21) + ' + id', 22)}, k, id) - 1) // 128)::bigint as batch_id
from bfs where d >= 1""",
    ),
)
def batches(spark, sf):
    return P.batches(train_pairs(spark, sf), 128, h(h("src", 21) + F.col("dst"), 22), "src", "dst")


@register(
    "first_samples",
    S.query(S.graph("supply") + [S.top(4), S.bfs()], f"select k as src, id as dst, d from bfs where d >= 1 order by {h_sql('id', 23)}, id, k limit 500"),
)
def first_samples(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return P.first_samples(P.train_pairs(T.landmark_table(g, _top(g, 4))), 500, h("dst", 23), "dst", "src")


@register(
    "negative_samples",
    S.query(
        S.graph("link")
        + [
            S.top(6),
            S.bfs(),
            "pos as (select k as u, id as v, d from bfs where d >= 1 union all select id, k, d from bfs where d >= 1)",
            "voc as (select id, row_number() over (order by id) - 1 as slot from nodes)",
            f"""neg as (select p.u as src, x.id as dst, 0.0::double as target from pos p cross join range(1, 4) j(j)
  join voc x on x.slot = {wide_sql(h_sql(h_sql('p.u', 14) + ' + p.v', 15) + ' + j.j', 16)} % (select count(*) from nodes))""",
        ],
        "select u as src, v as dst, d::double as target from pos union all select src, dst, target from neg",
    ),
)
def negative_samples(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return P.negative_samples(P.train_pairs(T.landmark_table(g, _top(g, 6))), g.nodes, g.n, 3, seed=14)


@register(
    "sample_bundle",
    S.query(
        S.graph("link") + [S.top(8)] + S.drawn("nodes", "nodes", 1, 100, "v1") + S.drawn("nodes", "nodes", 1, 200, "t1") + APSP,
        f"""select k as src, id as dst, d, 'train' as split from bfs where k in (select id from seeds)
union all select k, id, d, 'landmark' from bfs where k in (select id from seeds) and id in (select id from seeds) and k <> id
union all select p.src, p.dst, {_DIST}, 'val' from v1 p left join bfs b on b.k = p.src and b.id = p.dst
union all select p.src, p.dst, {_DIST}, 'test' from t1 p left join bfs b on b.k = p.src and b.id = p.dst""",
    ),
)
def sample_bundle(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return P.bundle(g, _top(g, 8))[0]


# ------------------------------------------------------------------- oracles (O)
_UPPER = """upper_b as (select p.src, p.dst, min(x.d + y.d) as est, max(abs(x.d - y.d)) as low from drawn p
  left join bfs x on x.id = p.src left join bfs y on y.id = p.dst and y.k = x.k group by p.src, p.dst)"""


def _classical(spark, sf, k, seed, name="link"):
    g = graphs.graph(spark, sf, name)
    return g, P.draw_partners(g.nodes.select(F.col("id").alias("src")), g.nodes, g.n, k, seed)


@register(
    "landmark_upper",
    S.query(S.graph("trade") + S.drawn("nodes", "nodes", 10, 0) + [S.top(32), S.bfs(), _UPPER], "select src, dst, est from upper_b"),
)
def landmark_upper(spark, sf):
    g, pairs = _classical(spark, sf, 10, 0, "trade")
    return LandmarkOracle.build(g, 32).query(pairs)


@register(
    "landmark_lower",
    S.query(S.graph("supply") + S.drawn("nodes", "nodes", 10, 0) + [S.top(16), S.bfs(), _UPPER], "select src, dst, low as est from upper_b"),
)
def landmark_lower(spark, sf):
    g, pairs = _classical(spark, sf, 10, 0, "supply")
    return LandmarkOracle.build(g, 16).lower(pairs)


@register(
    "landmark_margin_choice",
    S.query(
        S.graph("link")
        + [
            "ranked as (select id, row_number() over (order by deg desc, id) as rk from nodes)",
            """ball as (select r.rk, r.id, list(distinct y.id) as near from ranked r
  left join (select src as id0, dst as id from arcs union select a.src, b.dst from arcs a join arcs b on b.src = a.dst) y on y.id0 = r.id
  group by r.rk, r.id)""",
            """pick(i, chosen) as (select 0::bigint, []::bigint[]
  union all select p.i + 1, case when len(p.chosen) < 40 and not list_has_any(b.near, p.chosen) then list_append(p.chosen, b.id) else p.chosen end
  from pick p join ball b on b.rk = p.i + 1)""",
            "got as (select chosen from pick order by i desc limit 1)",
            "main as (select unnest(chosen) as id from got)",
            "rest as (select id from ranked where id not in (select id from main) order by rk limit 40)",
        ],
        """select id from main union all
select id from (select id, row_number() over (order by rk) as n from ranked where id not in (select id from main))
where n <= 40 - (select count(*) from main)""",
    ),
)
def landmark_margin_choice(spark, sf):
    return choose_landmarks(graphs.graph(spark, sf, "link"), 40, margin=2)


_CANON = """ranked as (select id, row_number() over (order by deg desc, id) as rk from nodes),
canon as (select b.k as hub, b.id, b.d from bfs b join ranked r on r.id = b.k where not exists (
  select 1 from bfs x join bfs y on y.k = x.k join ranked q on q.id = x.k
  where x.id = b.k and y.id = b.id and q.rk < r.rk and x.d + y.d <= b.d))"""


@register("pll_labels", S.query(S.graph("link") + APSP + [_CANON], "select id, hub, d from canon"))
def pll_labels(spark, sf):
    return LabelOracle.build(graphs.graph(spark, sf, "link")).tables["labels"].select("id", "hub", "d")


@register(
    "pll_query",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 10, 17) + APSP,
        "select p.src, p.dst, coalesce(b.d, 9999) as est from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def pll_query(spark, sf):
    g, pairs = _classical(spark, sf, 10, 17)
    return LabelOracle.build(g).query(pairs)


@register(
    "pll_closeness_query",
    S.query(
        S.graph("geo") + S.drawn("nodes", "nodes", 5, 18) + ["asked as (select distinct src as id from drawn)", S.bfs("asked")],
        "select p.src, p.dst, coalesce(b.d, 9999) as est from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def pll_closeness_query(spark, sf):
    g, pairs = _classical(spark, sf, 5, 18, "geo")
    return LabelOracle.build(g, by="closeness", seed=1).query(pairs)


@register(
    "pll_tree_order_query",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 5, 19) + APSP,
        "select p.src, p.dst, coalesce(b.d, 9999) as est from drawn p left join bfs b on b.k = p.src and b.id = p.dst",
    ),
)
def pll_tree_order_query(spark, sf):
    g, pairs = _classical(spark, sf, 5, 19)
    return LabelOracle.build(g, order=sampled_tree_order(g)).query(pairs)


@register(
    "node_order",
    S.query(
        S.graph("trade") + [f"seeds as (select id from nodes order by {h_sql('id', 4)}, id limit 32)", S.bfs(), "m as (select id, avg(d) as x from bfs group by id)"],
        "select n.id, row_number() over (order by coalesce(m.x, 'inf'::double), n.id) - 1 as rk from nodes n left join m on m.id = n.id",
    ),
)
def node_order_query(spark, sf):
    return node_order(graphs.graph(spark, sf, "trade"), "closeness", seed=4, samples=32)


def _ado_ctes(k: int, seed: int) -> list[str]:
    best = f"(select id from nodes order by {h_sql('id', seed + 1)}, id limit 1)"
    cut = f"(floor(2147483647 * pow((select count(*) from nodes), -1.0 / {k})))"
    keep, cases = "", []
    conds = []
    for i in range(1, k):
        conds.append(f"({h_sql('id', seed + i)} < {cut} or id = {best})")
        keep = " and ".join(conds)
        cases.append(f"when {keep} then {i}")
    tops = "case " + " ".join(reversed(cases)) + " else 0 end"
    return [
        f"lv as (select id, {tops} as top from nodes)",
        f"levels as (select i::int as level from range({k}) r(i))",
        "pivd as (select l.level, b.id, min(b.d) as delta from levels l join lv w on w.top >= l.level join bfs b on b.k = w.id group by l.level, b.id)",
        """piv as (select p.level, p.id, p.delta, min(b.k) as p from pivd p join bfs b on b.id = p.id and b.d = p.delta
  join lv w on w.id = b.k and w.top >= p.level group by p.level, p.id, p.delta)""",
        """bunch as (select b.id, b.k as w, b.d from bfs b join lv w on w.id = b.k
  left join pivd p on p.level = w.top + 1 and p.id = b.id where b.d < coalesce(p.delta, 1073741824) or b.d = 0)""",
    ]


@register("ado_bunches", S.query(S.graph("link") + APSP + _ado_ctes(2, 0), "select id, w, d from bunch"))
def ado_bunches(spark, sf):
    return ApproxOracle.build(graphs.graph(spark, sf, "link"), 2).tables["bunch"]


@register(
    "ado_query",
    S.query(
        S.graph("link")
        + S.drawn("nodes", "nodes", 8, 20)
        + APSP
        + _ado_ctes(3, 2)
        + [
            """s0 as (select q.src, q.dst, p.delta + b.d as est from drawn q join piv p on p.level = 0 and p.id = q.src
  left join bunch b on b.id = q.dst and b.w = p.p)""",
            """s1 as (select q.src, q.dst, coalesce(q.est, p.delta + b.d) as est from s0 q left join piv p on p.level = 1 and p.id = q.dst
  left join bunch b on b.id = q.src and b.w = p.p)""",
            """s2 as (select q.src, q.dst, coalesce(q.est, p.delta + b.d) as est from s1 q left join piv p on p.level = 2 and p.id = q.src
  left join bunch b on b.id = q.dst and b.w = p.p)""",
        ],
        "select src, dst, est from s2",
    ),
)
def ado_query(spark, sf):
    g, pairs = _classical(spark, sf, 8, 20)
    return ApproxOracle.build(g, 3, seed=2).query(pairs)

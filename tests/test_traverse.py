import pytest

from hopgraph.operators import traverse as T
from tests import tiny


@pytest.mark.parametrize("name", ["A", "C", "D"])
def test_all_pairs(spark, name):
    got = {(r.src, r.id): r.d for r in T.all_pairs(tiny.graph(spark, name)).collect()}
    want = {(u, v): d for u, row in tiny.apsp(name).items() for v, d in row.items()}
    assert got == want


def test_searches_in_bits(spark):
    """More than a block of sources, some of them out of reach of each other."""
    from hopgraph.operators.bitsearch import BitSweep, all_distances, in_blocks
    from hopgraph.operators.graph import Graph
    from hopgraph.operators.shape import clean

    ring = spark.range(150).selectExpr("id as src", "(id + 1) % 150 as dst").union(spark.range(200, 205).selectExpr("id", "id + 1"))
    g = Graph.build(clean(ring))
    got = {(r.src, r.id): r.d for r in all_distances(g, g.nodes).collect()}
    want = {(a, b): min((a - b) % 150, (b - a) % 150) for a in range(150) for b in range(150)}
    want |= {(a, b): abs(a - b) for a in range(200, 206) for b in range(200, 206)}
    assert got == want
    near = {(r.src, r.id): r.d for r in all_distances(g, g.nodes.filter("id < 70"), 3).collect()}
    assert near == {k: d for k, d in want.items() if k[0] < 70 and d <= 3}
    assert all_distances(g, g.nodes.filter("id < 0")).count() == 0
    seeds = in_blocks(g.nodes.select("id"), "id")
    sweep = BitSweep(g, seeds.select("block", "id", seeds.bit.alias("m")))
    sweep.advance()
    assert sweep.sizes[1] < 200 < 2 * 150  # neighbours' searches share rows


def test_one_source_and_unreachable(spark):
    g = tiny.graph(spark, "D")
    src = tiny.ids(spark, 0)
    full = T.with_unreachable(T.distances(g, src), src, g.nodes)
    got = {r.id: r.d for r in full.collect()}
    assert got[3] == -1 and got[2] == 1 and len(got) == 12


@pytest.mark.parametrize("name", ["B", "D"])
def test_pair_distances_both_ways(spark, name):
    g = tiny.graph(spark, name)
    ap = tiny.apsp(name)
    wanted = [(u, v) for u in ap for v in ap]
    df = tiny.pairs(spark, wanted)
    want = sorted((u, v, ap[u].get(v, -1)) for u, v in wanted)
    assert tiny.rows(T.pair_distances(g, df)) == want
    assert tiny.rows(T.source_to_targets(g, df)) == want


def test_shortest_paths_are_paths(spark):
    g = tiny.graph(spark, "A")
    ap, adj = tiny.apsp("A"), tiny.adjacency("A")
    rows = T.shortest_paths(g, tiny.pairs(spark, [(u, v) for u in ap for v in ap])).collect()
    for r in rows:
        assert r.path[0] == r.src and r.path[-1] == r.dst and len(r.path) == r.d + 1 == ap[r.src][r.dst] + 1
        assert all(b in adj[a] for a, b in zip(r.path, r.path[1:]))
    by = {(r.src, r.dst): r.path for r in rows}
    assert by[(3, 5)] == [3, 1, 4, 5]  # smallest parent at every step


def _count(adj, dist, u, v):
    if u == v:
        return 1
    return sum(_count(adj, dist, u, w) for w in adj[v] if dist[u].get(w, -1) == dist[u][v] - 1)


def test_path_counts_and_enumeration(spark):
    g = tiny.graph(spark, "B")
    ap, adj = tiny.apsp("B"), tiny.adjacency("B")
    got = {(r.src, r.id): r.paths for r in T.path_counts(g, g.nodes).collect()}
    assert got == {(u, v): _count(adj, ap, u, v) for u in ap for v in ap}
    want = [(0, 7), (9, 14), (3, 8), (5, 5)]
    paths = T.enumerate_paths(g, tiny.pairs(spark, want)).collect()
    for u, v in want:
        mine = {tuple(r.path) for r in paths if (r.src, r.dst) == (u, v)}
        assert len(mine) == got[(u, v)]
        assert all(len(p) == ap[u][v] + 1 for p in mine)


def test_components(spark):
    assert tiny.rows(T.component_sizes(T.components(tiny.graph(spark, "D")))) == [(0, 3), (3, 4), (7, 5)]
    assert tiny.rows(T.component_sizes(T.components(tiny.graph(spark, "C")))) == [(0, 22)]
    assert T.is_connected(tiny.graph(spark, "C")) and not T.is_connected(tiny.graph(spark, "D"))


def test_components_long_chain(spark):
    from hopgraph.operators.graph import Graph
    from hopgraph.operators.shape import clean

    chain = spark.range(500).selectExpr("id as src", "id + 1 as dst").filter("src <> 249")
    got = tiny.rows(T.component_sizes(T.components(Graph.build(clean(chain)))))
    assert got == [(0, 250), (250, 251)]


def test_nearest_seed(spark):
    g = tiny.graph(spark, "A")
    ap = tiny.apsp("A")
    got = {r.id: (r.seed, r.d) for r in T.nearest_seed(g, tiny.ids(spark, 0, 5, 10)).collect()}
    for v in ap:
        d = min(ap[s][v] for s in (0, 5, 10))
        assert got[v] == (min(s for s in (0, 5, 10) if ap[s][v] == d), d)


def test_layers(spark):
    g = tiny.graph(spark, "B")
    src = tiny.ids(spark, 4)
    assert T.layered_targets(g, src, depth=2, total=100).count() == 12
    per = T.layered_targets(g, src, depth=3, per_layer=2).groupBy("d").count()
    assert tiny.rows(per) == [(1, 2), (2, 2), (3, 2)]


def test_connecting_subgraph(spark):
    g = tiny.graph(spark, "F")
    got = tiny.rows(T.connecting_subgraph(g, tiny.ids(spark, 0, 4, 6)))
    assert got == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_arc_kinds(spark):
    g = tiny.graph(spark, "G")
    ap, adj = tiny.apsp("G"), tiny.adjacency("G")
    for r in T.arc_kinds(g, tiny.ids(spark, 2)).collect():
        dn, dc = ap[2][r.nbr], ap[2][r.cur]
        parent = min((w for w in adj[r.cur] if ap[2][w] == dc - 1), default=None)
        assert r.kind == (0 if parent == r.nbr else 1 if dn == dc else 2)


def test_directed_graph_uses_full_history(spark):
    from hopgraph.operators.graph import Graph

    ring = spark.range(7).selectExpr("id as src", "(id + 1) % 7 as dst")
    g = Graph.build(ring, symmetric=False)
    got = {r.id: r.d for r in T.distances(g, tiny.ids(spark, 0)).collect()}
    assert got == {i: i for i in range(7)}
    assert tiny.rows(T.pair_distances(g, tiny.pairs(spark, [(3, 2), (2, 3)]))) == [(2, 3, 1), (3, 2, 6)]


@pytest.mark.parametrize("name, least", [("A", 3), ("B", 4), ("D", 2)])
def test_pair_distances_past_hubs(spark, name, least):
    """Hubs of few neighbours, so that ways by hubs, past them and by none occur."""
    g = tiny.graph(spark, name)
    ap = tiny.apsp(name)
    wanted = [(u, v) for u in ap for v in ap]
    got = tiny.rows(T.pair_distances(g, tiny.pairs(spark, wanted), hub_degree=least))
    assert got == sorted((u, v, ap[u].get(v, -1)) for u, v in wanted)


def test_pairs_of_a_star_need_no_search(spark, monkeypatch):
    """Searches from the leaves of hubs would list all leaves of the hubs, once per search."""
    from hopgraph.operators.graph import Graph
    from hopgraph.operators.shape import clean

    ends = spark.range(200).selectExpr("id as src", "1000 + id % 4 as dst")
    g = Graph.build(clean(ends.union(spark.range(3).selectExpr("1000 + id", "1001 + id"))))  # a chain of four stars
    monkeypatch.setattr(T.Sweep, "advance", lambda *a, **k: pytest.fail("searched"))
    pairs = spark.range(200).selectExpr("id as src", "id * 7 % 200 as dst")
    for r in T.pair_distances(g, pairs).collect():
        assert r.d == (0 if r.src == r.dst else 2 + abs(r.src % 4 - r.dst % 4))


@pytest.mark.parametrize("search", [T.shortest_paths, T.enumerate_paths])
def test_paths_search_connected_pairs_only(spark, monkeypatch, search):
    g = tiny.graph(spark, "D")
    pairs = tiny.pairs(spark, [(0, 1), (3, 0), (7, 4), (8, 5)])
    searched = []
    first = T.Sweep.__init__

    def spy(self, graph, seeds, *rest, **more):
        searched.extend(r.id for r in seeds.collect())
        first(self, graph, seeds, *rest, **more)

    monkeypatch.setattr(T.Sweep, "__init__", spy)
    got = {(r.src, r.dst): r.path for r in search(g, pairs).collect()}
    assert searched == [0]
    assert got[0, 1] == [0, 1] and not any(path for pair, path in got.items() if pair != (0, 1))

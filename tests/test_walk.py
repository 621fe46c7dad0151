from collections import Counter

import pytest

from hopgraph.operators import walk as K
from hopgraph.operators.stats import landmark_centrality
from hopgraph.operators.traverse import landmark_table
from tests import tiny


def _valid(paths, adj):
    return all(b in adj[a] for p in paths for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("kind", ["uniform", "pq", "gen", "n2v", "bfs", "bc"])
def test_walks_use_arcs(spark, kind):
    g, adj = tiny.graph(spark, "B"), tiny.adjacency("B")
    score = landmark_centrality(landmark_table(g, tiny.ids(spark, 3, 4)))
    rows = K.walks(g, g.nodes, kind, per_root=3, length=6, score=score, seed=5).collect()
    assert len(rows) == 45 and all(r.path[0] == r.root for r in rows)
    assert _valid([r.path for r in rows], adj)
    if K.KINDS[kind].avoid:
        assert all(len(set(r.path)) == len(r.path) for r in rows)
        for r in rows:
            assert len(r.path) == 6 or not (adj[r.path[-1]] - set(r.path))
    else:
        assert all(len(r.path) == 6 for r in rows)


def test_walks_are_deterministic(spark):
    g = tiny.graph(spark, "A")
    a = tiny.rows(K.walks(g, g.nodes, "gen", 2, 5, seed=1).select("root", "wid", "path"))
    b = tiny.rows(K.walks(g, g.nodes, "gen", 2, 5, seed=1).select("root", "wid", "path"))
    c = tiny.rows(K.walks(g, g.nodes, "gen", 2, 5, seed=2).select("root", "wid", "path"))
    assert a == b != c


def test_first_step_is_uniform_and_weighted(spark):
    g = tiny.graph(spark, "C")
    rows = K.walks(g, tiny.ids(spark, 0), "uniform", per_root=4000, length=2).collect()
    hits = Counter(r.path[1] for r in rows)
    assert set(hits) == set(range(1, 21)) and all(140 < c < 260 for c in hits.values())
    score = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id bigint, score double")
    rows = K.walks(g, tiny.ids(spark, 0), "bc", per_root=4000, length=2, score=score).collect()
    hits = Counter(r.path[1] for r in rows)
    assert set(hits) == {1, 2} and 0.7 < hits[1] / 4000 < 0.8


def test_exact_finish_matches_the_rule(spark):
    """With a single try nearly every step goes through the exact fallback."""
    g, adj = tiny.graph(spark, "B"), tiny.adjacency("B")
    walker = K.Walker(g)
    rows = walker.run(g.nodes, 5, 6, K.KINDS["bfs"], seed=3, tries=1).collect()
    assert _valid([r.path for r in rows], adj)
    assert all(len(r.path) == 6 or not (adj[r.path[-1]] - set(r.path)) for r in rows)


def test_restart_and_surf(spark):
    g, adj = tiny.graph(spark, "A"), tiny.adjacency("A")
    for r in K.walks(g, g.nodes, K.Rule(restart=0.5), 5, 8).collect():
        assert all(b in adj[a] or b == r.root for a, b in zip(r.path, r.path[1:]))
    for r in K.walks(g, g.nodes, K.Rule(surf=0.5), 5, 8).collect():
        assert all(b in adj[a] or b in adj[r.root] for a, b in zip(r.path, r.path[1:]))


def test_decay_bounds_resample(spark):
    g, adj, ap = tiny.graph(spark, "B"), tiny.adjacency("B"), tiny.apsp("B")
    score = landmark_centrality(landmark_table(g, tiny.ids(spark, 3, 4)))
    walked = K.walks(g, g.nodes, "bc_decay", per_root=2, length=5, score=score)
    assert _valid([r.path for r in walked.collect()], adj) and walked.count() == 30
    bounds = K.distance_bounds(g, walked)
    rows = bounds.collect()
    assert all(r.bound >= ap[r.root][r.id] for r in rows)
    assert {r.id for r in rows if r.root == 4} >= adj[4]
    out = K.resample(bounds, score, 0.5, out_walks=3, out_len=7)
    seen = {(r.root, r.id) for r in rows}
    got = out.collect()
    assert len(got) == 45
    for r in got:
        assert r.path[0] == r.root and len(r.path) == 8 and all((r.root, x) in seen for x in r.path[1:])


def test_star_profile_coverage(spark):
    g, adj = tiny.graph(spark, "C"), tiny.adjacency("C")
    for r in K.star_walks(g, g.nodes, 6).collect():
        assert r.path == [r.root] + sorted(adj[r.root])[:5]
    from pyspark.sql import functions as F

    typed = K.walks(g, g.nodes, "gen", 2, 4).withColumn("type", F.lit("gen"))
    prof = {r.pos: r for r in K.profile(g, typed).collect()}
    assert prof[0].max_d == 0 and prof[1].avg_d == 1.0
    assert all(r.nodes >= 2 for r in K.coverage(typed).collect())


@pytest.mark.parametrize("kind", ["uniform", "bfs", "bc_decay"])
def test_rows_and_guide_table_pick_alike(spark, kind):
    """Neighbours held in a row (large blocks) and hubs (blocks of 4) give the same walks."""
    found = []
    for block in (4, 1024):
        g = tiny.graph(spark, "B", block)
        score = landmark_centrality(landmark_table(g, tiny.ids(spark, 3, 4)))
        found.append(tiny.rows(K.walks(g, g.nodes, kind, 2, 4, score, seed=7).select("root", "wid", "path", "stuck")))
    assert found[0] == found[1]


def test_steps_store_and_shuffle_little(spark, monkeypatch):
    """Eight steps without hubs store the start and two states, and no step has a join row per proposal."""
    stored = []
    write = K.Scratch.write

    def counted(self, df, name, **extra):
        if "/walk-" in self.root:
            stored.append((name, df.columns))
        return write(self, df, name, **extra)

    monkeypatch.setattr(K.Scratch, "write", counted)
    g = tiny.graph(spark, "A", 1024)
    rows = K.Walker(g).run(g.nodes, 2, 9, K.KINDS["gen"], seed=1).collect()
    assert len(rows) == 22 and [n for n, _ in stored] == ["s0", "s4", "s8"]
    assert all(set(c) == {"root", "wid", "cur", "blks", "path", "alive"} for _, c in stored)


def test_walk_bc_weighs_by_shortest_paths(spark, monkeypatch):
    """The query takes log(1 + share of all shortest paths), not what landmarks tell."""
    import math

    from hopgraph.operators import stats as S
    from hopgraph.plans import catalogue_models as Q

    g = tiny.graph(spark, "B")
    monkeypatch.setattr(Q.graphs, "graph", lambda *a: g)
    used = []
    monkeypatch.setattr(K, "Walker", lambda *a, made=K.Walker: used.append(made(*a)) or used[-1])
    rows = Q._walks("bc", 1, 6, "supply")(spark, "").collect()
    assert len(rows) == 15 and _valid([[int(x) for x in r.path.split("-")] for r in rows], tiny.adjacency("B"))
    want = {r.id: math.log1p(r.share) for r in S.sp_share(g).collect()}
    assert {r.dst: r.w for r in used[0].weight.collect()} == pytest.approx(want)

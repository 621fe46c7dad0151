import math

import pytest
from pyspark.sql import functions as F

from hopgraph.operators import stats as S
from hopgraph.operators import traverse as T
from tests import tiny


@pytest.mark.parametrize("name,diam,rad", [("A", 4, 2), ("B", 4, 3), ("C", 2, 2), ("D", -1, -1), ("F", 5, 3), ("G", 4, 2)])
def test_diameter_radius(spark, name, diam, rad):
    assert tiny.rows(S.diameter_radius(tiny.graph(spark, name), batch=2)) == [(diam, rad)]


def test_degree_stats(spark):
    r = S.degree_stats(tiny.graph(spark, "B").nodes).first()
    assert (r.n, r.m, r.max_deg, r.min_deg) == (15, 20, 5, 1)
    assert r.avg_deg == pytest.approx(40 / 15) and r.ratio == pytest.approx(20 / 15)


def _all_paths(adj, dist, u, v):
    if u == v:
        return [[u]]
    return [p + [v] for w in adj[v] if dist[u].get(w, -1) == dist[u][v] - 1 for p in _all_paths(adj, dist, u, w)]


@pytest.mark.parametrize("at_once", [10**6, 4])
def test_sp_share(spark, at_once):
    adj, ap = tiny.adjacency("B"), tiny.apsp("B")
    paths = [p for u in ap for v in ap if u < v for p in _all_paths(adj, ap, u, v)]
    want = {v: sum(v in p for p in paths) / len(paths) for v in ap}
    got = {r.id: r.share for r in S.sp_share(tiny.graph(spark, "B"), at_once=at_once).collect()}
    assert got == pytest.approx(want)


def test_tree_betweenness(spark):
    adj, ap = tiny.adjacency("G"), tiny.apsp("G")
    want = dict.fromkeys(ap, 0)
    for s in ap:
        parent = {v: min((w for w in adj[v] if ap[s][w] == ap[s][v] - 1), default=None) for v in ap}
        for t in ap:
            v = parent[t]
            while v is not None and v != s:
                want[v] += 1
                v = parent[v]
    got = {r.id: r.score for r in S.tree_betweenness(tiny.graph(spark, "G"), at_once=3).collect()}
    assert got == want


def test_landmark_centrality_and_closeness(spark):
    g, ap = tiny.graph(spark, "A"), tiny.apsp("A")
    got = {r.id: r.score for r in S.landmark_centrality(T.landmark_table(g, tiny.ids(spark, 3, 8))).collect()}
    for v in ap:
        assert got[v] == pytest.approx(sum(1 if ap[s][v] == 0 else 1 / ap[s][v] for s in (3, 8)))
    mean = {r.id: r.mean_d for r in S.closeness_sampled(g, 11).collect()}
    assert mean[3] == pytest.approx(sum(ap[3].values()) / 11)


def test_normalise_card_histogram(spark):
    scores = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id bigint, score double")
    assert tiny.rows(S.normalise(scores)) == [(1, 0.25), (2, 0.75)]
    log = {r.id: r.score for r in S.normalise(scores, "log").collect()}
    assert log[1] == pytest.approx(math.log(2) / (math.log(2) + math.log(4)))
    assert sum(r.score for r in S.normalise(scores, "sigmoid").collect()) == pytest.approx(1)
    card = S.data_card(tiny.graph(spark, "A").nodes, scores).first()
    assert card.score_range == pytest.approx(2 / 11)
    h = S.length_histogram(tiny.pairs(spark, [(0, 1)]).select(F.lit(2).alias("d"))).first()
    assert (h.d, h.cnt, h.share) == (2, 1, 1.0)


def test_walk_frequency(spark):
    w = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 2])], "root bigint, path array<bigint>")
    assert [tuple(r) for r in S.walk_frequency(w).collect()] == [(2, 3), (3, 2), (1, 1)]
    assert [r.id for r in S.roots_by_frequency(w).collect()] == [2, 1]


def test_bounds_from_searches_in_bits(spark):
    """Bounds of every node are those of one search after the other."""
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    for chosen in ([3], [0, 9, 14], sorted(ap)):
        got = {r.id: (r.lo2, r.up2) for r in S._bounds_from(g, tiny.ids(spark, *chosen), S.Scratch(spark, "test")).collect()}
        ecc = {s: max(ap[s].values()) for s in chosen}
        assert got == {v: (max(max(ap[s][v], ecc[s] - ap[s][v]) for s in chosen), min(ecc[s] + ap[s][v] for s in chosen)) for v in ap}
